"""Feed normalisation, identifiers and makers: queries over parts and line items written as raw feed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import makers, text
from ..operators import feed_rows
from ..sinks import exports
from .catalog import query
from .tables import Tables

ALIASES = {"BRAND#2": "ACME", "BRAND#7": "LEK", "BRAND#9": "SANDOZ", "BRAND#11 LABS": "LABS"}
_MAKER = "CASE b WHEN 'BRAND#2' THEN 'ACME' WHEN 'BRAND#7' THEN 'LEK' WHEN 'BRAND#9' THEN 'SANDOZ' ELSE b END"

#: Raw rows in SQL: what each field holds, before any rule.
_RAW = """WITH raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey + 1 END AS goods_id, upper(p_brand) AS b, p_size, p_name, l_linenumber AS ln, l_quantity AS q, l_suppkey AS supp, l_shipdate AS day,
 CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 END AS own, CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN -1.5 ELSE l_quantity + 0.25 END AS discounted,
 CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE p_name || ' N' || p_size || ' ' || p_size || ' мл' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
 n AS (SELECT *, CASE WHEN own IS NOT NULL THEN CASE WHEN own > 0 THEN own END WHEN discounted > 0 THEN discounted END AS price,
 CASE WHEN own IS NOT NULL THEN CASE WHEN own > 0 THEN NULL ELSE 'invalid_price' END WHEN discounted > 0 THEN NULL WHEN discounted IS NULL THEN 'missing_price' ELSE 'invalid_price' END AS bad FROM raw),
 k AS (SELECT *, coalesce(bad, CASE WHEN name IS NULL THEN 'missing_name' END) AS reason, CASE WHEN ln % 2 = 0 THEN CASE b WHEN 'BRAND#2' THEN 'ACME' WHEN 'BRAND#7' THEN 'LEK' WHEN 'BRAND#9' THEN 'SANDOZ' ELSE b END ELSE '' END AS maker,
 CASE WHEN supp % 4 = 0 THEN '' WHEN supp % 4 = 1 THEN 'barcode:' || (100000 + supp) ELSE 'sku:s-' || supp END AS variant, CASE WHEN ln % 3 = 0 THEN 'box:' || ln ELSE coalesce('n' || p_size || '|' || p_size || 'мл', '') END AS pack FROM n)
"""


def raw(t: Tables) -> DataFrame:
    """Line items as rows of a feed, some of them with faults."""
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    x = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat("p_name", F.lit(" N"), "p_size", F.lit(" "), "p_size", F.lit(" мл"))
    name = F.when(F.col("l_orderkey") % 13 != 0, F.concat(name, F.lit(" цена 100 тг")))
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    own = F.when(line % 5 == 0, None).when(line % 5 == 1, "0").otherwise(F.regexp_replace(F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string"), r"\.", ","))
    return x.select(
        (F.col("l_orderkey") * 10 + line).alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_partkey") + 1).alias("goodsId"), own.alias("goodsPrice"),
        F.when(supp % 3 == 0, None).when(supp % 3 == 1, "-1.5").otherwise((F.col("l_quantity") + 0.25).cast("string")).alias("goodsPriceWithUserDiscount"), supp.alias("filialId"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("insertedDate"),
        F.when(supp % 4 == 0, " ").when(supp % 4 == 1, (supp + 100000).cast("string")).otherwise(F.concat(F.lit(" S-"), supp, F.lit("!"))).alias("distributorGoodsId"),
        F.when(line % 2 == 0, F.concat(F.lit("ООО \""), "p_brand", F.lit("\", Ltd."))).alias("distributorProducer"), F.when(line % 3 == 0, line).alias("box"), F.col("l_quantity").alias("stored"),
        F.struct(name.alias("fullName"), F.lit("").alias("regNumber")).alias("goods"),
    )


def _normalized(t: Tables, repeated: bool = False) -> DataFrame:
    return feed_rows.normalize(raw(t), F.lit(1), F.lit("main"), makers.alias_array(ALIASES), repeated)


@query(_RAW + "SELECT id AS source_item_id, reason AS skip_reason, goods_id, supp AS filial_id, round(price, 2) AS price, q AS stock, maker AS manufacturer, variant AS variant_key, CASE WHEN name IS NULL AND ln % 3 <> 0 THEN '' ELSE pack END AS pack_signature, lower(maker) AS producer, coalesce(own < 0, false) OR coalesce(discounted < 0, false) AS negative_price FROM k")
def q_emit_normalize(t: Tables) -> DataFrame:
    return _normalized(t).select("source_item_id", "skip_reason", "goods_id", "filial_id", F.round("price", 2).alias("price"), "stock", "manufacturer", "variant_key", "pack_signature", F.regexp_replace("producer_key", " ", "#").alias("producer"), "negative_price")


@query(_RAW + "SELECT coalesce(reason, 'saved') AS outcome, count(*) AS n FROM k GROUP BY ALL")
def q_skip_reasons(t: Tables) -> DataFrame:
    return feed_rows.outcome_counts(_normalized(t))


_ID = "CASE WHEN goods_id IS NOT NULL AND variant <> '' THEN 'goodsId+variant|' || goods_id || '|' || variant WHEN goods_id IS NOT NULL THEN 'goodsId+pack+producer|' || goods_id || '|' || pack || '|' || replace(lower(maker), '#', ' ') ELSE 'fallback|' || lower(p_name) || ' n' || p_size || ' ' || p_size || ' мл' || '|' || replace(lower(maker), '#', ' ') || '|' || pack || '|' || variant END"


@query(_RAW + f", i AS (SELECT *, {_ID} AS identity FROM k WHERE reason IS NULL) SELECT identity, count(*) AS rows_seen, min(price) AS price, arg_min(id, (CASE WHEN maker <> '' THEN 0 ELSE 1 END, price, -epoch(day), id)) AS source_item_id FROM (SELECT *, CASE WHEN maker <> '' THEN 1 ELSE 0 END AS m, max(CASE WHEN maker <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY identity) AS mm FROM i) WHERE TRUE GROUP BY identity, mm HAVING TRUE")
def q_feed_best(t: Tables) -> DataFrame:
    """The best offer of each identity: with a maker before without, then the cheapest, then the newest."""
    good = feed_rows.accepted(_normalized(t, True))
    offers = good.select("source_item_id", "goods_id", "name", "price", "manufacturer", "variant_key", "pack_signature", "producer_key", "name_key", "source_timestamp")
    return feed_rows.best_offers(offers, F.min("price").alias("lowest")).select(F.array_join("identity", "|").alias("identity"), "rows_seen", F.col("lowest").alias("price"), "source_item_id")


@query(_RAW + "SELECT supp AS filial_id, count(*) AS rows_seen, count(DISTINCT (id, price, q, day)) AS observations, count(*) FILTER (goods_id IS NULL) AS without_goods FROM (SELECT * FROM k WHERE reason IS NULL UNION ALL SELECT * FROM k WHERE reason IS NULL) GROUP BY supp")
def q_feed_observations(t: Tables) -> DataFrame:
    """A feed delivered twice has the same observations."""
    good = feed_rows.accepted(_normalized(t, True))
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    keyed = good.select("filial_id", "goods_id", feed_rows.logical_key().alias("k")).withColumn("delivery", twice)
    once = keyed.groupBy("filial_id", "k").agg(F.count("*").alias("n"), F.count_if(F.col("goods_id").isNull()).alias("w"))
    return once.groupBy("filial_id").agg(F.sum("n").alias("rows_seen"), F.count("*").alias("observations"), F.sum("w").alias("without_goods"))


@query("SELECT l_suppkey AS branch, l_partkey AS sku, min(l_extendedprice) AS price, sum(l_quantity) AS stock, arg_min(l_shipmode, (l_extendedprice, l_shipmode)) AS maker FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY ALL")
def q_branch_aggregate(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("sku"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("stock"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("maker"))
    return feed_rows.aggregate_in_branch(rows, ["branch", "sku"], "price", "stock")


# ---- identifiers and names


@query("WITH x AS (SELECT p_partkey, '00' || (p_partkey + 10) AS a FROM part) SELECT p_partkey, a || ',' || lpad(a, 18, '0') || ',' || regexp_replace(a, '^0+', '') AS lookup, 'm_' || a || '_' || p_partkey AS composite, p_partkey || '7' AS plain, CASE WHEN length('99' || a) BETWEEN 6 AND 18 THEN 'barcode:99' || a ELSE 'sku:99-' || a END AS sku_key, CASE WHEN length('99' || a) BETWEEN 6 AND 18 THEN '99' || a ELSE '' END AS barcode, a || ',' || lpad(a, 18, '0') || ',' || (p_partkey + 10) AS variants FROM x")
def q_sku_variants(t: Tables) -> DataFrame:
    a = F.concat(F.lit("00"), F.col("p_partkey") + 10)
    spaced = F.concat(F.lit(" "), F.left(a, F.lit(2)), F.lit(" "), F.expr("substr(concat('00', p_partkey + 10), 3)"))
    return t.part.select(
        "p_partkey", F.array_join(text.sku_lookup(spaced), ",").alias("lookup"), text.composite_sku(F.concat(F.lit("m_ "), a, F.lit("__"), F.col("p_partkey"))).alias("composite"), text.sku_plain(F.concat(F.lit(" "), F.col("p_partkey"), F.lit("-7.0"))).alias("plain"),
        text.sku_key(F.concat(F.lit("99-"), a)).alias("sku_key"), text.barcode(F.concat(F.lit("99-"), a)).alias("barcode"), F.array_join(text.sku_variants(a), ",").alias("variants"),
    )


@query("WITH x AS (SELECT p_partkey, p_name AS n, p_size AS s, upper(p_brand) AS b FROM part) SELECT p_partkey, n || ' 5,5 мг' AS name_key, CASE WHEN s > 0 THEN 'n' || s || '|' || s || 'таб|5,5мг' END AS packs, s AS pack_count, '5.5мг,2%' AS doses, replace(replace(n, ' ', ','), ',,', ',') AS words FROM x WHERE TRUE")
def q_name_parts(t: Tables) -> DataFrame:
    n, s = F.col("p_name"), F.col("p_size").cast("string")
    return t.part.select(
        "p_partkey", text.without_price_noise(F.concat(n, F.lit(" 5,5 МГ 120 тг Цена: "), s)).alias("name_key"), text.pack_signature_of(F.concat(n, F.lit(" N "), s, F.lit(" "), s, F.lit(" таб 5,5 мг 2%"))).alias("packs"),
        text.pack_count(F.concat(n, F.lit(" номер "), s)).alias("pack_count"), F.array_join(text.unit_tokens(F.lit("5,5 мг и 2 %")), ",").alias("doses"), F.array_join(text.tokens(F.concat(n, F.lit(" и к"))), ",").alias("words"),
    )


_PAIR = f"WITH x AS (SELECT p_partkey, upper(p_brand) AS b, upper('Brand#' || (p_size % 25 + 1)) AS c FROM part), y AS (SELECT p_partkey, {_MAKER} AS a, {_MAKER.replace('CASE b', 'CASE c').replace('ELSE b', 'ELSE c')} AS m FROM x) "


@query(_PAIR + "SELECT p_partkey, a AS maker, a AS resolved, a AS extracted, CASE WHEN a = m THEN 'match' WHEN least(a, m) = 'LEK' AND greatest(a, m) = 'SANDOZ' THEN 'hard_reject' ELSE 'other' END AS decision, CASE WHEN a = m THEN 'alias_match' WHEN least(a, m) = 'LEK' AND greatest(a, m) = 'SANDOZ' THEN 'hard_reject' ELSE 'other' END AS required, a = m AS same FROM y")
def q_maker_decisions(t: Tables) -> DataFrame:
    """What depends on the ratio of two names stands as ``other``; the ratio itself is tested against its definition."""
    al = makers.alias_array(ALIASES)
    x = t.part.select("p_partkey", F.concat(F.lit(" - «\""), "p_brand", F.lit("\" D.D., ООО")).alias("one"), F.concat(F.lit("brand#"), F.col("p_size") % 25 + 1, F.lit(" GmbH")).alias("two"), F.concat(F.lit("таб. производитель: "), "p_brand", F.lit(", ТОО")).alias("name"))
    x = x.withColumn("a", F.regexp_replace(makers.normalize(F.translate("one", "«", " "), al), "^ ", "")).withColumn("b", makers.normalize(F.col("two"), al)).withColumn("score", makers.ratio("a", "b"))
    known = lambda c: F.when(c.isin("match", "alias_match", "hard_reject"), c).otherwise("other")
    return x.select(
        "p_partkey", F.col("a").alias("maker"), makers.resolve_pair(F.lit(" нет"), F.col("name"), al)["maker"].alias("resolved"), makers.extract(F.col("name"), al).alias("extracted"),
        known(makers.decision(F.col("a"), F.col("b"), F.col("score"))).alias("decision"), known(makers.required(F.col("a"), F.col("b"), F.col("score"))).alias("required"), makers.same(F.col("a"), F.col("b")).alias("same"),
    )


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS goods_id, 'n' || l_suppkey AS filial_name, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS shelf_life, NULL AS batch, CAST(l_quantity AS INT) AS stock FROM lineitem")
def q_flat_rows(t: Tables) -> DataFrame:
    k = F.col("l_linenumber")
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + k).alias("id"), F.when(k % 3 != 0, F.col("l_partkey")).alias("goodsId"), F.struct(F.concat(F.lit(" n"), "l_suppkey").alias("name")).alias("filial"), F.lit(" ").alias("batch"), F.col("l_quantity").cast("int").alias("stored"),
        F.when(k % 2 == 0, F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).otherwise("0001-01-01T00:00:00").alias("shelfLife"), F.struct(F.lit("x").alias("fullName")).alias("goods"),
    )
    x = feed_rows.flatten(rows)
    return x.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("goods_id").cast("bigint").alias("goods_id"), "filial_name", "shelf_life", "batch", F.col("stock").cast("int").alias("stock"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'price_formats' WHEN 2 THEN 'markup_ranges' WHEN 3 THEN 'universal_lists' END AS kind FROM supplier")
def q_sheet_types(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 5
    words = F.when(k == 0, F.array(*map(F.lit, ("код", "name", "закуп")))).when(k == 1, F.array(*map(F.lit, ("цф", "филиал")))).when(k == 2, F.array(*map(F.lit, ("cost_from", "наценка")))).when(k == 3, F.array(*map(F.lit, ("type", "status", "name")))).otherwise(F.array(F.lit("code")))
    return t.supplier.select("s_suppkey", feed_rows.sheet_type(words).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN chr(39) || '=' || p_name ELSE p_name END AS name, p_size, min(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", min(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_size")
def q_export_wide(t: Tables) -> DataFrame:
    priced = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("name"), "p_size")
    rivals = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("title"), F.col("l_quantity").alias("price"))
    return exports.safe(exports.wide(priced, rivals, "p_partkey", ["A", "R"]))
