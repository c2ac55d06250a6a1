"""Names, codes, typed cells and pricing modes: queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, numbers, values
from ..operators import modes, ranges
from .catalog import query
from .tables import Tables, sql

_FAM = "CASE s_suppkey % 5 WHEN 0 THEN 'аманат' WHEN 1 THEN 'зерде' WHEN 2 THEN 'стофарм' WHEN 3 THEN 'атамирас' ELSE lower(s_name) END"


@query(f"SELECT s_suppkey, {_FAM} AS identity, CASE s_suppkey % 5 WHEN 0 THEN 'Аманат' WHEN 1 THEN 'Зерде' WHEN 2 THEN 'Стофарм' WHEN 3 THEN 'Атамирас' ELSE s_name END AS shown, CASE s_suppkey % 5 WHEN 0 THEN 14 WHEN 1 THEN 15 WHEN 2 THEN 14 WHEN 3 THEN 15 ELSE 0 END AS obsolete, 'percentile:competitor:4:regular_competitor:' || {_FAM} || ':' || ':' || s_name || ':p' || (10 * (1 + s_suppkey % 4)) AS source, CASE WHEN s_suppkey % 7 > 0 THEN {_FAM} END AS parsed, CASE WHEN s_suppkey % 7 > 0 THEN 10 * (1 + s_suppkey % 4) END AS percentile FROM supplier")
def q_competitor_identity(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 5
    written = F.when(k == 0, " АМАНАТ ( Алматы )").when(k == 1, "Зерде  ТОО НПО").when(k == 2, "стофарм").when(k == 3, F.concat(F.lit("Атамирас ТОО "), "s_name")).otherwise(F.col("s_name"))
    who = identity.competitor(F.lit(""), written)
    x = t.supplier.select("s_suppkey", "s_name", who.alias("identity"))
    source = F.concat(F.lit("percentile:"), identity.percentile_source(F.lit("other"), F.lit(4), F.lit("regular_competitor"), F.col("identity"), F.lit(None), F.col("s_name"), 10 * (1 + F.col("s_suppkey") % 4)))
    x = x.withColumn("source", source)
    parsed = identity.parsed_source(F.col("source"), F.when(F.col("s_suppkey") % 7 == 0, 5).otherwise(4))
    return x.select("s_suppkey", "identity", identity.shown_name(F.col("identity"), F.col("s_name")).alias("shown"), F.size(identity.obsolete_names(F.col("identity"))).alias("obsolete"), "source", parsed["identity"].alias("parsed"), parsed["percentile"].alias("percentile"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '17' WHEN 2 THEN '15' ELSE s_name END AS branch, CASE WHEN s_suppkey % 2 = 0 THEN 3 END AS city, CASE s_suppkey % 3 WHEN 0 THEN 'min_price' WHEN 1 THEN 'exclude_from_pricing' ELSE 'other' END AS list_type, s_suppkey % 3 = 0 AS active, s_suppkey % 5 = 0 OR s_suppkey = 7 AS multi, CASE WHEN s_suppkey % 4 = 0 THEN 'own' WHEN s_suppkey % 5 = 0 THEN 'multi_price' ELSE '' END AS mode, s_suppkey % 3 <> 0 AND s_suppkey % 25 IN (3, 4) AS allowed FROM supplier")
def q_branch_codes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda n, *cs: F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in cs]), (k % n + 1).cast("int"))
    shown = F.when(k % 5 == 0, F.lit("Amity International")).otherwise(F.lit("plain"))
    return t.supplier.select(
        "s_suppkey", identity.branch_id(pick(4, " 010", "шымкент", "Oral", F.col("s_name"))).alias("branch"), identity.city_id(F.when(k % 2 == 0, " Актау").otherwise("Нигде")).alias("city"), identity.list_type(pick(3, "Минимальная цена", "exclusion", "other")).alias("list_type"),
        identity.is_active(pick(3, "Active since May", "архивный", "new")).alias("active"), identity.is_multi_price(k, ("7",), shown).alias("multi"), identity.percentile_mode(F.lit("web"), F.when(k % 4 == 0, " own"), shown).alias("mode"),
        values.allowed_source(k % 25, F.when(k % 3 == 0, 2).otherwise(1), {1: [3, 4]}).alias("allowed"),
    )


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'k' || s_suppkey WHEN 1 THEN 'emit:' || s_suppkey WHEN 2 THEN 'account:' || s_nationkey || ':plk:' || s_suppkey WHEN 3 THEN s_nationkey || ':' || s_suppkey WHEN 4 THEN 'manual:' || s_suppkey ELSE 'web:' || s_nationkey || ':b' END AS source_key, CASE WHEN s_suppkey % 2 = 0 THEN 'vidman:' || s_suppkey ELSE 'vidman:name:' || replace(lower(s_name), '#', ' ') || '|manufacturer:acme' END AS match_key, CASE s_suppkey % 4 WHEN 0 THEN 'Provisor ' || s_suppkey WHEN 1 THEN 'Фармцентр ' || s_suppkey WHEN 2 THEN 'x:' || s_suppkey ELSE 'other' END AS pretty, CASE s_suppkey % 4 WHEN 0 THEN 'provisor' WHEN 1 THEN 'phcenter' WHEN 2 THEN 'manual' ELSE 'other' END AS source_type FROM supplier")
def q_source_identity(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("x", "Emit", "provisor", "vidman", "manual", "web"))), (k % 6 + 1).cast("int"))
    external = F.when(k % 6 != 5, k)
    source = F.when(k % 4 == 0, F.concat(F.lit("provisor:"), k)).when(k % 4 == 1, F.concat(F.lit("phcenter:"), k)).when(k % 4 == 2, F.concat(F.lit("manual:x:"), k)).otherwise("other")
    return t.supplier.select(
        "s_suppkey", identity.source_key(F.when(k % 6 == 0, F.concat(F.lit("k"), k)), kind, F.col("s_nationkey"), external, F.lit("b"), F.lit(False)).alias("source_key"),
        identity.match_key(F.lit(" Vidman"), F.when(k % 2 == 0, k), F.col("s_name"), F.lit("ACME!")).alias("match_key"), identity.pretty_source(source).alias("pretty"), identity.source_type(source).alias("source_type"),
    )


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 12.0 END AS value, CASE p_size % 6 WHEN 1 THEN '-' ELSE '' END AS special, CASE p_size % 6 WHEN 3 THEN 'negative_price' WHEN 4 THEN 'missing_price' END AS error, p_size + 0.5 AS bare, CASE WHEN p_size % 2 = 0 THEN p_size END AS positive, p_size || ',50' AS comma, 400.0 AS dose, p_size || '.25' AS clean FROM part")
def q_list_values(t: Tables) -> DataFrame:
    k, s = F.col("p_size") % 6, F.col("p_size").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("Минимальная наценка", "critical_markup", "без прогиба", "min_price", "меморандум", "max_markup"))), (k + 1).cast("int"))
    cell = F.when(k == 0, F.concat(s, F.lit(",5 %"))).when(k == 1, " - ").when(k == 2, "").when(k == 3, F.concat(F.lit("-"), s, F.lit("1"))).when(k == 4, "abc").otherwise("0,12")
    v = values.list_value(kind, cell)
    even = F.when(F.col("p_size") % 2 == 0, F.concat(s, F.lit(",0"))).otherwise(F.concat(s, F.lit(".5")))
    return t.part.select(
        "p_partkey", v["value"].alias("value"), v["special"].alias("special"), v["error"].alias("error"), values.bare_decimal(F.concat(F.lit("KZT "), s, F.lit(",5 тг"))).alias("bare"), values.positive_whole(even).alias("positive"),
        values.comma_decimal(F.concat(s, F.lit(".5"))).alias("comma"), values.dose_mg(F.lit(0.4)).alias("dose"), values.clean_number(F.col("p_size") + F.lit(0.25)).alias("clean"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey + 7 END AS ids, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a,b' END AS strings, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS cust, 'v' || o_orderkey AS region, 'open' AS status, o_orderpriority || ',x' AS sample, o_orderkey % 2 = 0 AS filled FROM orders")
def q_tolerant_json(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    bad = lambda c: F.when(k % 3 == 0, "not json").otherwise(c)
    ids = values.id_list(bad(F.concat(F.lit("["), k, F.lit(", null, 7]"))))
    return t.orders.select(
        "o_orderkey", F.aggregate(ids, F.lit(0), lambda a, x: a + x).cast("bigint").alias("ids"), F.array_join(values.json_strings(bad(F.lit('[" a", "", "b"]'))), ",").alias("strings"),
        F.try_element_at(values.json_map(bad(F.concat(F.lit('{"c": "'), "o_custkey", F.lit('"}')))), F.lit("c")).alias("cust"), F.element_at(values.pairs(F.concat(F.lit("a:1; r:v"), k)), "r").alias("region"), values.region_status(F.lit("x; status: open ; y:1")).alias("status"),
        F.array_join(values.sample(F.array(F.col("o_orderpriority"), F.lit(" "), F.concat(F.lit(" "), "o_orderpriority"), F.lit("x"))), ",").alias("sample"), values.filled_row(F.array(F.lit(" "), F.when(k % 2 == 0, "y"))).alias("filled"),
    )


# ---- modes

_MODES = sql("products", "offers", "regional") + """, f AS (SELECT r_regionkey AS format, CASE r_regionkey WHEN 0 THEN 'regular' WHEN 1 THEN 'percentile' ELSE 'mixed' END AS mode, CASE r_regionkey WHEN 1 THEN 30 END AS pn FROM region),
 pv AS (SELECT product, nation, unnest([10, 20, 30, 40, 60]) AS percentile, round(unnest(quantile_cont(cents, [0.1, 0.2, 0.3, 0.4, 0.6])) * 100) / 100 AS v FROM regional GROUP BY product, nation),
 reg AS (SELECT region AS format, product, min(cents) AS p, source FROM regional GROUP BY region, product, source),
 adm AS (SELECT f.format, product, p FROM reg JOIN f USING (format) WHERE mode <> 'percentile' UNION ALL
   SELECT f.format, product, v * (100 + nation) / 100 FROM pv JOIN nation ON nation = n_nationkey JOIN f ON f.format = n_regionkey WHERE mode = 'mixed' OR mode = 'percentile' AND percentile = coalesce(pn, 10)) """


def _percentile_values(t: Tables) -> DataFrame:
    v = t.regional.groupBy("product", "nation").agg(F.percentile("cents", F.array(*[F.lit(p / 100) for p in (10, 20, 30, 40, 60)])).alias("v"))
    return v.select("product", F.concat(F.lit("percentile:"), "nation").alias("source"), F.posexplode("v").alias("i", "value")).select("product", "source", F.element_at(F.array(*map(F.lit, (10, 20, 30, 40, 60))), F.col("i") + 1).alias("percentile"), (F.round(F.col("value") * 100) / 100).alias("value"))


def _admitted(t: Tables) -> DataFrame:
    r = F.col("r_regionkey")
    configs = t.nation.select(F.col("n_regionkey").alias("format"), F.concat(F.lit("percentile:"), "n_nationkey").alias("source"), ((F.col("n_nationkey") + 100) / 100).alias("coefficient"))
    physical = t.region.where(r != 1).select(r.alias("format"), F.lit("provisor:1").alias("source"), F.lit(1.0).alias("coefficient"))
    wanted = configs.where("format <> 0").unionByName(physical)
    formats = t.region.select(r.alias("format"), F.lit("Regular ").alias("mode"), F.when(r == 1, 30).alias("percentile_number"))
    found = modes.format_modes(formats, wanted).join(formats.select("format", "percentile_number"), "format")
    regular = t.regional.groupBy(F.col("region").alias("format"), "product", "source").agg(F.min("cents").cast(numbers.MONEY).alias("p")).withColumn("source", F.col("source").cast("string"))
    pct = modes.percentile_candidates(_percentile_values(t), F.broadcast(configs))  # 25 nations
    return modes.candidates_by_mode(F.broadcast(found), regular, pct)  # 5 formats


@query(_MODES + "SELECT format, count(*) AS candidates, count(DISTINCT product) AS products, round(sum(p), 2) AS total FROM adm GROUP BY format")
def q_mode_candidates(t: Tables) -> DataFrame:
    return _admitted(t).groupBy("format").agg(F.count("*").alias("candidates"), F.countDistinct("product").alias("products"), F.round(F.sum("p").cast("double"), 2).alias("total"))


@query(_MODES + "SELECT format, product, round(min(p), 4) AS reference FROM adm WHERE p > 0 GROUP BY ALL")
def q_zone_references(t: Tables) -> DataFrame:
    return modes.zone_references(_admitted(t)).withColumn("reference", F.col("reference").cast("double"))


@query("WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS product, l_suppkey % 5 AS format, 'r' || (l_suppkey % 3) AS region, 'c' || (l_suppkey % 4) AS rival, CASE l_linenumber % 3 WHEN 0 THEN 'emit:1' WHEN 1 THEN '' ELSE 'k2' END AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'regional' ELSE 'all' END AS scope, 10 * (1 + l_orderkey % 4) AS pct, l_suppkey % 7 AS s, l_quantity AS v FROM lineitem), "
       "x AS (SELECT *, region = 'r1' AND rival = 'c2' AND (key = 'k2' OR key = '') AS active, s < 3 AS configured FROM r) SELECT format, product, o, n, v * CASE WHEN configured THEN 1 + s / 10.0 ELSE 1 END AS p FROM x WHERE CASE WHEN key = 'emit:1' OR active THEN scope = 'regional' AND (configured OR pct = 20 AND active) ELSE configured END")  # fmt: skip
def q_percentile_gates(t: Tables) -> DataFrame:
    s, n, o = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
    rows = t.lineitem.select(
        F.concat_ws(":", F.lit("x"), s % 7, o, n).alias("tag"), F.col("l_partkey").alias("product"), (s % 5).alias("format"), F.concat(F.lit("r"), s % 3).alias("region"), F.concat(F.lit("c"), s % 4).alias("rival"), F.when(n % 3 == 0, "emit:1").when(n % 3 == 2, "k2").alias("key"),
        F.when(n % 2 == 0, "regional").otherwise("all").alias("scope"), (10 * (1 + o % 4)).alias("percentile"), F.concat(F.lit("s"), s % 7).alias("source"), F.col("l_quantity").alias("value"),
    )
    formats = t.region.select(F.col("r_regionkey").alias("format"))
    configs = formats.select("format", F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("source"), F.lit(1 + i / 10).alias("coefficient")) for i in range(3)])).alias("x")).select("format", "x.*")
    groups = formats.select("format", F.lit("r1").alias("region"), F.lit("c2").alias("rival"), F.lit("k2").alias("key"))
    keyed = rows.withColumn("product", F.struct("product", "tag"))
    out = modes.gated_percentiles(keyed, F.broadcast(configs), F.broadcast(groups), F.lit(20))  # 15 and 5 rows
    tag = F.split("product.tag", ":")
    return out.select("format", "product.product", tag[2].cast("bigint").alias("o"), tag[3].cast("bigint").alias("n"), F.col("p").cast("double").alias("p"))


@query("SELECT p_partkey, least(p_size, 20) AS price, p_size > 20 AS applied, CASE WHEN p_size > 20 THEN p_size END AS before, p_partkey % 3 = 0 AS below_floor, p_partkey % 2 = 0 AS duplicate, CASE WHEN p_partkey % 3 = 0 THEN 'memorandum_below_mdc' WHEN p_size > 20 THEN 'memorandum_cap' WHEN p_partkey % 2 = 0 THEN 'memorandum_duplicate_conflict' ELSE '' END AS code FROM part")
def q_memorandum(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    m = modes.memorandum(F.col("p_size").cast("int"), F.lit(20), F.when(k % 3 == 0, 21).otherwise(19), F.when(k % 2 == 0, 2).otherwise(1))
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


@query("WITH s AS (SELECT DISTINCT l_suppkey AS branch, l_partkey AS product FROM lineitem WHERE l_suppkey = 3), c AS (SELECT p_partkey AS product, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS cost FROM part WHERE p_size > 10), j AS (SELECT s.product, max(cost) AS cost FROM s LEFT JOIN c ON s.product = c.product AND cost > 0 GROUP BY 1) SELECT (SELECT count(*) FROM lineitem WHERE l_suppkey = 3) AS stock_rows, 0 AS unknown, count(*) AS products, (SELECT count(*) FROM lineitem WHERE l_suppkey = 3) - count(*) AS duplicates, count(cost) AS with_cost, count(*) - count(cost) AS without_cost FROM j")
def q_stock_reconciliation(t: Tables) -> DataFrame:
    """A branch's stock against its costs."""
    stock = t.lineitem.where("l_suppkey = 3").select(F.col("l_partkey").alias("product"))
    cost = t.part.where("p_size > 10").select(F.col("p_partkey").alias("product"), F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size")).alias("cost"))
    return modes.reconciliation(stock, modes.stock_snapshot(stock, cost))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q_not_in_stock(t: Tables) -> DataFrame:
    priced = t.orders.select("o_orderkey", F.col("o_custkey").alias("product"))
    return modes.not_in_stock(priced, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("product"))).withColumnRenamed("product", "o_custkey")


@query("WITH r AS (SELECT p_brand AS k, p_partkey AS cost_from, p_partkey + CASE WHEN p_size % 10 = 0 THEN -1 ELSE p_size END AS cost_to FROM part), b AS (SELECT *, max(cost_to) OVER (PARTITION BY k ORDER BY cost_from, cost_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r) SELECT k, cost_from, CASE WHEN cost_to <= cost_from THEN 'turned' WHEN e >= cost_from THEN 'overlap' END AS why FROM b WHERE cost_to <= cost_from OR e >= cost_from")
def q_invalid_ranges(t: Tables) -> DataFrame:
    r = t.part.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("cost_from"), (F.col("p_partkey") + F.when(F.col("p_size") % 10 == 0, -1).otherwise(F.col("p_size"))).alias("cost_to"))
    return ranges.invalid_ranges(r, ["k"]).select("k", "cost_from", "why")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Нет цен выбранных конкурентов. Применена глобальная шкала маржи для товаров без конкурентов.' WHEN 1 THEN 'Цена рассчитана относительно 2-й цены конкурента Provisor ' || p_size || '.' ELSE 'Цена рассчитана по основной шкале наценки: 15.00%.' END AS log, round((p_retailprice - p_size) * 100 / p_retailprice, 4) AS margin FROM part")
def q_calculation_log(t: Tables) -> DataFrame:
    k = F.col("p_size") % 3
    log = identity.calculation_log(F.when(k == 1, "competitor").otherwise("markup"), F.when(k != 0, 3), F.concat(F.lit("provisor:"), "p_size"), F.lit(2), F.lit(0.15), F.lit(False))
    return t.part.select("p_partkey", log.alias("log"), F.round(numbers.margin_percent(F.col("p_size"), F.col("p_retailprice")), 4).alias("margin"))


_SENTENCES = {
    "competitor_bend": "'Цена рассчитана относительно ' || (o_orderkey % 4 + 1) || '-й цены конкурента Provisor ' || o_custkey || '.'", "competitor_bend_c1": "'Цена рассчитана относительно ' || (o_orderkey % 4 + 1) || '-й цены конкурента Provisor ' || o_custkey || '.'",
    "all_competitors_failed_mdc": "'Ни одна цена конкурентов не прошла условие минимальной допустимой цены. Применена минимальная наценка.'", "mdc_floor_after_rounding": "'Цена поднята до МДЦ после округления или ограничений.'",
    "no_competitor_markup_bumped_to_mdc": "'Нет цен выбранных конкурентов. Цена по шкале без конкурентов ниже МДЦ, применена МДЦ.'",
    "mdc_floor_after_competitor": "'Цена установлена по минимальной наценке, так как первая цена конкурента list ' || (o_custkey % 7) || ' не прошла условие минимальной допустимой цены.'",
    "min_margin_floor": "'Цена поднята до минимальной наценки.'", "max_margin_cap": "'Цена ограничена максимальной наценкой.'", "fixed_price_list": "'Финальная цена установлена напрямую из фиксированной цены; выбор конкурента и прогиб не применялись.'",
    "markup": "'Цена рассчитана по основной шкале наценки: ' || printf('%.2f', (o_custkey % 50)::DOUBLE) || '%.'",
}


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Нет цен выбранных конкурентов. Применена шкала маржи для товаров без конкурентов с учетом Lists Management.' ELSE 'Нет цен выбранных конкурентов. Применена глобальная шкала маржи для товаров без конкурентов.' END ELSE CASE o_custkey % 10 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SENTENCES.values())) + " END END AS log FROM orders")
def q_calculation_sentences(t: Tables) -> DataFrame:
    """Every reason that a price can have, over all orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reason = F.element_at(F.array(*map(F.lit, _SENTENCES)), (c % 10 + 1).cast("int"))
    log = identity.calculation_log(reason, F.when(k % 3 == 0, 0).otherwise(2), F.concat(F.lit("provisor:"), c), k % 4 + 1, (c % 50).cast("decimal(18,4)") / 100, c % 2 == 0, F.concat(F.lit("manual:list "), c % 7))
    return t.orders.select("o_orderkey", log.alias("log"))
