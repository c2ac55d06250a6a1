"""Queries by operator and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, numbers, text
from ..operators import dedup, linkage, percentiles, pricing, ranges
from ..sources import feeds
from .tables import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LEVELS = percentiles.LEVELS


def query(oracle: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


OR = ("products", "offers", "regional")
_PCT = "unnest([10, 20, 30, 40, 60]) AS percentile, round(unnest(quantile_cont(cents, [0.1, 0.2, 0.3, 0.4, 0.6])) / 100, 4) AS value"


def money(c: str = "value"):
    return F.round(F.col(c) / 100, 4).alias("value")


# ---- percentiles


@query(sql(*OR) + f"SELECT product, nation, count(*) AS n_prices, count(DISTINCT source) AS n_sources, {_PCT} FROM regional GROUP BY product, nation")
def q_percentile_inc(t: Tables) -> DataFrame:
    p = percentiles.percentiles(t.regional, ["product", "nation"], "cents", "source")
    return p.select("product", "nation", "n_prices", "n_sources", "percentile", money())


@query(sql(*OR) + ", a AS (SELECT product, nation, region, unnest([10, 20, 30, 40, 60]) AS percentile, round(unnest(quantile_cont(cents, [0.1, 0.2, 0.3, 0.4, 0.6])) * 100) AS v FROM regional GROUP BY product, nation, region) "
       "SELECT product, region, percentile, count(*) AS n_groups, round(CASE percentile WHEN 10 THEN quantile_cont(v, 0.1) WHEN 20 THEN quantile_cont(v, 0.2) WHEN 30 THEN quantile_cont(v, 0.3) WHEN 40 THEN quantile_cont(v, 0.4) ELSE quantile_cont(v, 0.6) END / 10000, 5) AS value FROM a GROUP BY product, region, percentile")  # fmt: skip
def q_percentile_of_percentiles(t: Tables) -> DataFrame:
    """Regional values are stored with four places before the second level reads them."""
    a = percentiles.percentiles(t.regional, ["product", "nation", "region"], "cents", "source").withColumn("value", F.round(F.col("value") * 100))
    p = percentiles.percentile_of_percentiles(a, ["product", "region"])
    return p.select("product", "region", "percentile", "n_groups", F.round(F.col("value") / 10000, 5).alias("value"))


@query(sql(*OR) + f", v AS (SELECT nation, product, count(*) AS n_prices, {_PCT} FROM regional GROUP BY product, nation) "
       "SELECT n_nationkey AS nation, p.product, l.percentile, v.value, coalesce(v.n_prices, 0) AS n_prices, CASE coalesce(v.n_prices, 0) WHEN 0 THEN 'No data' WHEN 1 THEN 'One price' ELSE 'Calculated' END AS status "
       "FROM nation CROSS JOIN products p CROSS JOIN (SELECT unnest([10, 20, 30, 40, 60]) AS percentile) l LEFT JOIN v ON v.nation = n_nationkey AND v.product = p.product AND v.percentile = l.percentile")  # fmt: skip
def q_percentile_densified(t: Tables) -> DataFrame:
    v = percentiles.percentiles(t.regional, ["product", "nation"], "cents", "source").select("product", "nation", "percentile", "n_prices", money())
    return percentiles.densify(v, t.nation.select(F.col("n_nationkey").alias("nation")), t.products, ["nation"], "product")


@query(sql(*OR) + f"SELECT product, region, count(*) AS sample_count, min(cents) AS min_price, max(cents) AS max_price, count(DISTINCT source) AS source_count, {_PCT} FROM regional GROUP BY product, region")
def q_regular_percentiles(t: Tables) -> DataFrame:
    return percentiles.regular_percentiles(t.regional, ["product", "region"], "cents", "source").select("product", "region", "sample_count", "min_price", "max_price", "source_count", "percentile", money())


@query(sql(*OR) + f", v AS (SELECT product, {_PCT} FROM regional GROUP BY product) SELECT f.format, v.* FROM v CROSS JOIN (SELECT DISTINCT o_orderpriority AS format FROM orders) f")
def q_percentile_fanout(t: Tables) -> DataFrame:
    v = percentiles.percentiles(t.offers, ["product"], "cents", "source").select("product", "percentile", money())
    return percentiles.fan_out(v, t.orders.select(F.col("o_orderpriority").alias("format")).distinct())


# ---- scales and pricing

MARKUP = [(0, 74000, 20), (74001, 78000, 10), (78001, 130000, 4)]  # cents, percent; above the last: the last
NO_COMP = [(0, 90000, 3), (90001, None, 0)]
BEND = [(0, 5), (100000, 2), (140000, 1)]  # cents, tenths of a percent


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows) + f") s({names})"


def _scale(rows, kind: str):
    """A literal scale array: cents as money, percentages as fractions or points."""
    d = lambda v: F.lit(None if v is None else f"{v / 100:.2f}").cast(numbers.MONEY)
    if kind == "range":
        return F.array(*[F.struct(d(a).alias("cost_from"), d(b).alias("cost_to"), F.lit(f"{p / 100:.2f}").cast(numbers.FINE).alias("percent")) for a, b, p in rows])
    return F.array(*[F.struct(d(a).alias("price_from"), F.lit(f"{p / 10:.1f}").cast(numbers.FINE).alias("percent")) for a, p in rows])


_IN = f"coalesce((SELECT arg_min(pct, lo) FROM {_values(MARKUP, 'lo, hi, pct')} WHERE cost >= lo AND (hi IS NULL OR cost <= hi)), {MARKUP[-1][2]})"
_NC = f"(SELECT arg_min(pct, lo) FROM {_values(NO_COMP, 'lo, hi, pct')} WHERE cost >= lo AND (hi IS NULL OR cost <= hi))"


def _money(c: str):
    return (F.col(c).cast("decimal(18,4)") / 100).cast(numbers.MONEY)


@query(sql("products") + f"SELECT product, {_IN} / 100.0 AS markup FROM products")
def q_markup_range_join(t: Tables) -> DataFrame:
    return t.products.select("product", ranges.in_range(_scale(MARKUP, "range"), _money("cost")).cast("double").alias("markup"))


@query(sql("products") + f"SELECT product, CASE WHEN {_NC} <> 0 THEN {_NC} ELSE {_IN} END / 100.0 AS markup FROM products")
def q_no_competitor_range(t: Tables) -> DataFrame:
    cost = _money("cost")
    return t.products.select("product", ranges.in_range_or(_scale(NO_COMP, "range"), cost, ranges.in_range(_scale(MARKUP, "range"), cost)).cast("double").alias("markup"))


@query(sql("products", "offers") + f"SELECT ord, line, pct / 10.0 AS bend FROM offers ASOF LEFT JOIN (SELECT * FROM {_values(BEND, 'lo, pct')}) b ON cents >= lo")
def q_bend_asof_join(t: Tables) -> DataFrame:
    return t.offers.select("ord", "line", ranges.as_of(_scale(BEND, "step"), _money("cents"), F.lit(0)).cast("double").alias("bend"))


_PRICED = sql("products", "offers") + f""", m AS (SELECT product, cost, {_IN} AS mk, CASE WHEN {_NC} <> 0 THEN {_NC} ELSE {_IN} END AS nc FROM products),
 c AS (SELECT product, source, min(cents) AS p FROM offers GROUP BY ALL),
 b AS (SELECT c.*, pct AS b FROM c ASOF LEFT JOIN (SELECT * FROM {_values(BEND, 'lo, pct')}) b ON p >= lo),
 r AS (SELECT b.*, row_number() OVER (PARTITION BY product ORDER BY p, source) AS rk, p * (1000 - b) * (100 - mk) >= cost * 100000 AS ok FROM b JOIN m USING (product)),
 h AS (SELECT product, min(p) AS lowest, count(*) AS n, min(rk) FILTER (ok) AS rank, arg_min(source, rk) FILTER (ok) AS source, arg_min(p, rk) FILTER (ok) AS sp, arg_min(p * (1000 - b), rk) FILTER (ok) AS bent FROM r GROUP BY product),
 x AS (SELECT m.product, cost, mk, lowest, coalesce(n, 0) AS n, rank, source, sp, ceil(cost * 100 / (100 - mk))::BIGINT AS up,
   CASE WHEN n IS NULL THEN floor(cost * 100 / (100 - nc) + 0.5) WHEN rank IS NULL THEN floor(cost * 100 / (100 - mk) + 0.5) ELSE (bent + 500) // 1000 END::BIGINT AS r FROM m LEFT JOIN h USING (product)),
 f AS (SELECT *, CASE WHEN r * (100 - mk) < cost * 100 THEN up ELSE r END AS final FROM x),
 priced AS (SELECT product, final, CASE WHEN n = 0 THEN 'no_competitors' WHEN rank IS NULL THEN 'all_competitors_failed_mdc' ELSE 'competitor' END AS reason, source, sp AS source_price, rank, n AS n_candidates, cost, lowest,
   CASE WHEN lowest IS NULL THEN NULL WHEN final < lowest THEN 'left' WHEN final * 100 <= lowest * 103 THEN 'optimal' ELSE 'right' END AS zone FROM f) """


def priced(t: Tables) -> DataFrame:
    """Every product through the cascade, in whole cents."""
    offers = t.offers.select("product", "source", _money("cents").alias("price"), F.lit(1).alias("coef"))
    none = t.spark.createDataFrame([], "product bigint, list_type string, value decimal(18,6), special_value string")
    out = pricing.price(
        t.products.select("product", _money("cost").alias("cost")), pricing.candidates(offers), pricing.rule_values(none),
        _scale(MARKUP, "range"), _scale(NO_COMP, "range"), _scale(BEND, "step"), F.lit(0), F.lit("0.01").cast(numbers.FINE), F.lit("math"),
    )
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    return out.select("product", cents("final").alias("final"), "reason", "source", cents("source_price").alias("source_price"), F.col("rank").cast("bigint").alias("rank"), F.col("n_candidates").cast("bigint").alias("n_candidates"), "zone", cents("cost").alias("cost"))


@query(_PRICED + "SELECT product, final, reason, source, source_price, rank, n_candidates, zone FROM priced")
def q_candidate_search(t: Tables) -> DataFrame:
    return priced(t).drop("cost")


@query(_PRICED + "SELECT coalesce(zone, 'none') AS zone, count(*) AS n, sum(final) AS total, round(avg(final), 4) AS mean FROM priced GROUP BY ALL")
def q_zone_distribution(t: Tables) -> DataFrame:
    return priced(t).groupBy(F.coalesce("zone", F.lit("none")).alias("zone")).agg(F.count("*").alias("n"), F.sum("final").alias("total"), F.round(F.avg("final"), 4).alias("mean"))


@query(_PRICED + "SELECT count(*) AS total, count(*) FILTER (n_candidates > 0) AS with_competitors, count(*) - count(*) FILTER (n_candidates > 0) AS without_competitors, count(*) FILTER (reason = 'competitor') AS by_competitor, count(*) FILTER (reason = 'all_competitors_failed_mdc') AS failed, count(*) FILTER (zone = 'right') AS right_zone, min(final) AS lowest, max(final) AS highest, round(100.0 * count(*) FILTER (zone = 'optimal') / count(*), 2) AS optimal_percent FROM priced")
def q_analytics_summary(t: Tables) -> DataFrame:
    some = F.col("n_candidates") > 0
    return priced(t).agg(
        F.count("*").alias("total"), F.count_if(some).alias("with_competitors"), (F.count("*") - F.count_if(some)).alias("without_competitors"),
        F.count_if(F.col("reason") == "competitor").alias("by_competitor"), F.count_if(F.col("reason") == "all_competitors_failed_mdc").alias("failed"), F.count_if(F.col("zone") == "right").alias("right_zone"),
        F.min("final").alias("lowest"), F.max("final").alias("highest"), F.round(100.0 * F.count_if(F.col("zone") == "optimal") / F.count("*"), 2).alias("optimal_percent"),
    )


@query(_PRICED + "SELECT (final - cost) * 100 // final // 5 * 5 AS margin_from, count(*) AS n FROM priced GROUP BY ALL")
def q_markup_histogram(t: Tables) -> DataFrame:
    band = F.expr("(final - cost) * 100 DIV final DIV 5 * 5")
    return priced(t).groupBy(band.alias("margin_from")).agg(F.count("*").alias("n"))


@query(_PRICED + "SELECT reason, CASE WHEN rank > 1 THEN 'higher_competitor' WHEN rank = 1 THEN 'lowest_competitor' ELSE 'floor' END AS why, count(*) AS n FROM priced WHERE zone = 'right' GROUP BY ALL")
def q_right_reasons(t: Tables) -> DataFrame:
    why = F.when(F.col("rank") > 1, "higher_competitor").when(F.col("rank") == 1, "lowest_competitor").otherwise("floor")
    return priced(t).where("zone = 'right'").groupBy("reason", why.alias("why")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey AS product, CAST(round(p_retailprice * 100) AS BIGINT) AS c, CASE p_size % 3 WHEN 0 THEN 5 WHEN 1 THEN 100 ELSE 25 END AS q FROM part) SELECT product, (2 * c + q) // (2 * q) * q AS half_up, (c + q - 1) // q * q AS up, c // q * q AS down FROM c")
def q_rounding_modes(t: Tables) -> DataFrame:
    q = F.when(F.col("p_size") % 3 == 0, 5).when(F.col("p_size") % 3 == 1, 100).otherwise(25)
    c = t.part.select(F.col("p_partkey").alias("product"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("c"), q.alias("q")).withColumn("m", _money("c"))
    step = (F.col("q").cast("decimal(10,4)") / 100).cast(numbers.FINE)
    return c.select("product", *[(numbers.round_to(F.col("m"), step, F.lit(mode)) * 100).cast("bigint").alias(name) for name, mode in (("half_up", "math"), ("up", "up"), ("down", "down"))])


@query(sql("products", "offers") + ", l AS (SELECT product, min(cents) AS low, max(cents) AS high FROM offers GROUP BY product) SELECT product, CASE WHEN high < low THEN 'left' WHEN high * 100 <= low * 103 THEN 'optimal' ELSE 'right' END AS zone FROM l")
def q_price_zones(t: Tables) -> DataFrame:
    o = t.offers.groupBy("product").agg(F.min("cents").alias("low"), F.max("cents").alias("high"))
    return o.select("product", numbers.zone(_money("high"), _money("low")).alias("zone"))


# ---- rule lists: items derived from parts

_ITEMS = sql("products") + """, items AS (SELECT product, 'min_price' AS list_type, retail + 500 AS v, product % 3 AS list_id FROM products JOIN part ON product = p_partkey WHERE p_size % 5 = 0
 UNION ALL SELECT product, 'max_price', retail - 700, product % 3 FROM products JOIN part ON product = p_partkey WHERE p_size % 7 = 0
 UNION ALL SELECT product, 'memorandum', retail - 900 - product % 4, 7 FROM products JOIN part ON product = p_partkey WHERE p_size % 4 = 0
 UNION ALL SELECT product, 'memorandum', retail - 901, 8 FROM products JOIN part ON product = p_partkey WHERE p_size % 8 = 0) """


def _items(t: Tables) -> DataFrame:
    x = t.products.join(t.part.select(F.col("p_partkey").alias("product"), "p_size"), "product")
    rule = lambda n, kind, v, lid: x.where(F.col("p_size") % n == 0).select("product", F.lit(kind).alias("list_type"), v.alias("v"), lid.cast("int").alias("list_id"))
    r, p = F.col("retail"), F.col("product")
    return rule(5, "min_price", r + 500, p % 3).unionByName(rule(7, "max_price", r - 700, p % 3)).unionByName(rule(4, "memorandum", r - 900 - p % 4, F.lit(7))).unionByName(rule(8, "memorandum", r - 901, F.lit(8)))


@query(_ITEMS + "SELECT product, least(CASE WHEN mx IS NOT NULL THEN least(greatest(retail, coalesce(mn, 0)), mx) ELSE greatest(retail, coalesce(mn, 0)) END, coalesce(cap, 1000000000)) AS final, coalesce(n_caps, 0) AS n_caps FROM products LEFT JOIN (SELECT product, max(v) FILTER (list_type = 'min_price') AS mn, max(v) FILTER (list_type = 'max_price') AS mx, min(v) FILTER (list_type = 'memorandum') AS cap, count(*) FILTER (list_type = 'memorandum') AS n_caps FROM items GROUP BY product) USING (product)")
def q_rule_cascade(t: Tables) -> DataFrame:
    items = _items(t).select("product", "list_type", (F.col("v").cast("decimal(18,6)") / 100).cast(numbers.FINE).alias("value"), F.lit(None).cast("string").alias("special_value"))
    one = t.products.select("product", _money("retail").alias("price"), F.lit(1).alias("coef"), F.lit(1).alias("source"))
    none = F.array(F.struct(F.lit(0).cast(numbers.MONEY).alias("price_from"), F.lit(0).cast(numbers.FINE).alias("percent")))
    out = pricing.price(t.products.select("product", F.lit("0.01").cast(numbers.MONEY).alias("cost")), pricing.candidates(one), pricing.rule_values(items), _scale([(0, None, 0)], "range"), _scale([(0, None, 0)], "range"), none, F.lit(0), F.lit("0.01").cast(numbers.FINE), F.lit("math"))
    n = pricing.rule_values(items).select("product", "n_caps")
    return out.join(n, "product", "left").select("product", (F.col("final") * 100).cast("bigint").alias("final"), F.coalesce("n_caps", F.lit(0)).alias("n_caps"))


@query(_ITEMS + "SELECT product, list_type, count(*) AS n FROM (SELECT product, list_type FROM items UNION ALL SELECT product, 'min_price' FROM products WHERE product % 10 = 0) WHERE list_type <> 'memorandum' GROUP BY ALL HAVING count(*) > 1")
def q_rule_conflicts(t: Tables) -> DataFrame:
    more = t.products.select("product", F.when(F.col("product") % 10 == 0, "min_price").otherwise("memorandum").alias("list_type"))  # caps never conflict
    return pricing.conflicts(_items(t).select("product", "list_type").unionByName(more))


@query(_ITEMS + "SELECT product, min(v) AS cap, arg_min(list_id, (v, list_id)) AS list_id, count(*) > 1 AS duplicate FROM items WHERE list_type = 'memorandum' AND v > 0 GROUP BY product")
def q_cap_lowest(t: Tables) -> DataFrame:
    caps = _items(t).where("list_type = 'memorandum' AND v > 0")
    return caps.groupBy("product").agg(F.min("v").alias("cap"), F.min_by("list_id", F.struct("v", "list_id")).alias("list_id"), (F.count("*") > 1).alias("duplicate"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'inactive' WHEN s > DATE '1996-01-01' THEN 'not_started' WHEN e < DATE '1996-01-01' THEN 'expired' ELSE 'active' END AS status FROM (SELECT *, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 365 END AS e FROM orders)")
def q_active_lists_interval(t: Tables) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(start, 365))
    return t.orders.select("o_orderkey", dates.list_status(F.col("o_orderstatus") != "P", start, end, F.lit("1996-01-01").cast("date")).alias("status"))


# ---- joins


@query("WITH i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS k1, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 50 END AS k2, l_suppkey AS k3 FROM lineitem), p AS (SELECT p_partkey, p_partkey % 60 AS s, p_partkey % 90 AS d FROM part) "
       "SELECT l_orderkey, l_linenumber, coalesce(a.id, b.id, c.id) AS matched_id, CASE WHEN a.id IS NOT NULL THEN 'k1' WHEN b.id IS NOT NULL THEN 'k2' WHEN c.id IS NOT NULL THEN 'k3' END AS match_kind FROM i LEFT JOIN (SELECT p_partkey AS k, min(p_partkey) AS id FROM p GROUP BY 1) a ON k1 = a.k LEFT JOIN (SELECT s AS k, min(p_partkey) AS id FROM p GROUP BY 1) b ON k2 = b.k LEFT JOIN (SELECT d AS k, min(p_partkey) AS id FROM p GROUP BY 1) c ON k3 = c.k")  # fmt: skip
def q_lateral_key_cascade(t: Tables) -> DataFrame:
    i = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).alias("k1"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 50).alias("k2"), F.col("l_suppkey").alias("k3"))
    p = t.part.select("p_partkey", F.col("p_partkey").alias("goods"), (F.col("p_partkey") % 60).alias("sku"), (F.col("p_partkey") % 90).alias("dist"))
    return linkage.key_cascade(i, p, [("k1", "goods"), ("k2", "sku"), ("k3", "dist")], "p_partkey").select("l_orderkey", "l_linenumber", "matched_id", "match_kind")


@query("SELECT l_orderkey AS k, min(l_suppkey) AS v FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def q_unambiguous_backfill(t: Tables) -> DataFrame:
    return linkage.unambiguous(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v")), ["k"], "v")


@query("SELECT a.id AS part_id, b.id AS supplier_id, count(*) AS shared_keys FROM (SELECT p_partkey AS id, unnest([p_size % 10, 100 + p_partkey % 40]) AS k FROM part) a JOIN (SELECT s_suppkey AS id, unnest([s_suppkey % 10, 100 + s_suppkey % 40]) AS k FROM supplier) b ON a.k = b.k GROUP BY ALL")
def q_blocking_pairs(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("part_id"), F.array(F.col("p_size").cast("bigint") % 10, F.col("p_partkey").cast("bigint") % 40 + 100).alias("ka"))
    b = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.array(F.col("s_suppkey").cast("bigint") % 10, F.col("s_suppkey").cast("bigint") % 40 + 100).alias("kb"))
    return linkage.blocked_pairs(a, b, F.col("ka"), F.col("kb"), "part_id", "supplier_id")


@query("WITH a AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1) SELECT o_custkey, a.v AS before, b.v AS after, round(100.0 * (b.v - a.v) / a.v, 2) AS change_percent FROM a JOIN b USING (o_custkey)")
def q_compare_runs(t: Tables) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    both = t.orders.select("o_custkey", cents.alias("v"), (F.col("o_orderdate") < "1996-01-01").alias("old"))
    x = both.groupBy("o_custkey").agg(F.sum(F.when(F.col("old"), F.col("v"))).alias("before"), F.sum(F.when(~F.col("old"), F.col("v"))).alias("after"))
    return x.where("before IS NOT NULL AND after IS NOT NULL").withColumn("change_percent", F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 2))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_semi_filter(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_anti_stale(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, s_suppkey, CASE WHEN n_name = s THEN 'exact' ELSE 'substring' END AS how FROM nation, (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' north' ELSE 'elsewhere' END AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE contains(s, n_name) OR contains(n_name, s)")
def q_branch_theta(t: Tables) -> DataFrame:
    """Branches of suppliers against the names of nations, equal or one within the other."""
    home = t.supplier.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("home"))), "s_nationkey")  # 25 nations
    k = F.col("s_suppkey") % 3
    s = home.select("s_suppkey", F.when(k == 0, F.col("home")).when(k == 1, F.concat("home", F.lit(" north"))).otherwise("elsewhere").alias("branch"))
    pairs = s.join(F.broadcast(t.nation), F.contains("branch", F.col("n_name")) | F.contains("n_name", F.col("branch")))
    return pairs.select("n_nationkey", "s_suppkey", F.when(F.col("branch") == F.col("n_name"), "exact").otherwise("substring").alias("how"))


@query(sql(*OR) + "SELECT product, min(cents) FILTER (region = 0) AS r0, min(cents) FILTER (region = 1) AS r1, min(cents) FILTER (region = 2) AS r2, min(cents) FILTER (region = 3) AS r3, min(cents) FILTER (region = 4) AS r4 FROM regional GROUP BY product")
def q_branch_pivot(t: Tables) -> DataFrame:
    p = t.regional.groupBy("product").pivot("region", [0, 1, 2, 3, 4]).agg(F.min("cents"))
    return p.select("product", *[F.col(str(i)).alias(f"r{i}") for i in range(5)])


@query("WITH w AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS d1_price, CAST(round(p_retailprice * 100) AS BIGINT) + 100 AS d2_price, CASE WHEN p_size % 2 = 0 THEN p_size * 100 END AS d3_price FROM part) SELECT p_partkey, source, price FROM (UNPIVOT w ON d1_price, d2_price, d3_price INTO NAME source VALUE price) WHERE price IS NOT NULL")
def q_wide_to_long(t: Tables) -> DataFrame:
    c = F.round(F.col("p_retailprice") * 100).cast("bigint")
    w = t.part.select("p_partkey", c.alias("d1_price"), (c + 100).alias("d2_price"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("bigint") * 100).alias("d3_price"))
    return w.unpivot("p_partkey", ["d1_price", "d2_price", "d3_price"], "source", "price").where("price IS NOT NULL")


# ---- windows, top-k, sets


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q_latest_rating(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return dedup.best_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def q_dedupe_best(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")
    return dedup.max_per_key(x, ["l_partkey", "l_suppkey"], F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")).drop("l_quantity")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q_dedupe_first_low_id(t: Tables) -> DataFrame:
    x = t.events.select("user_id", "event_type", "event_id")
    return dedup.best_per_key(x, ["user_id", "event_type"], F.asc("event_id"))


@query("WITH f AS (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first FROM events), d AS (SELECT user_id, event_id, dense_rank() OVER (ORDER BY first) AS position, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS price_index, count(*) OVER (PARTITION BY user_id) AS prices FROM f) SELECT * FROM d WHERE position <= 50")
def q_first_positions(t: Tables) -> DataFrame:
    """The first 50 positions in order of appearance: ranked after one row per position is left, never over all rows."""
    e = t.events.select("user_id", "event_id")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"), F.count("*").alias("prices")).orderBy("first").limit(50)
    first = first.withColumn("position", F.row_number().over(Window.orderBy("first"))).drop("first")
    return e.join(F.broadcast(first), "user_id").select("user_id", "event_id", "position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("price_index"), "prices")  # 50 rows


@query("SELECT s_suppkey, s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) - min(CAST(round(s_acctbal * 100) AS BIGINT)) OVER (PARTITION BY s_nationkey) AS above_min FROM supplier")
def q_partition_min(t: Tables) -> DataFrame:
    c = F.round(F.col("s_acctbal") * 100).cast("bigint")
    return t.supplier.select("s_suppkey", "s_nationkey", (c - F.min(c).over(Window.partitionBy("s_nationkey"))).alias("above_min"))


@query(sql("products", "offers") + ", b AS (SELECT product, source, min(cents) AS p FROM offers GROUP BY ALL) SELECT product, array_to_string(list_sort(list(lpad(CAST(p AS VARCHAR), 9, '0') || '@' || source))[:5], ',') AS top5 FROM b GROUP BY product")
def q_topk_prices(t: Tables) -> DataFrame:
    b = t.offers.groupBy("product", "source").agg(F.min("cents").alias("p"))
    return b.groupBy("product").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("p").cast("string"), 9, "0"), F.lit("@"), "source"))), 1, 5), ",").alias("top5"))


@query(sql("products", "offers") + "SELECT product, max(cents) - min(cents) AS spread FROM offers GROUP BY product ORDER BY spread DESC, product LIMIT 25")
def q_topn_change(t: Tables) -> DataFrame:
    return t.offers.groupBy("product").agg((F.max("cents") - F.min("cents")).alias("spread")).orderBy(F.desc("spread"), "product").limit(25)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a%' ORDER BY p_brand, p_partkey LIMIT 50 OFFSET 100")
def q_page(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%a%")).orderBy("p_brand", "p_partkey").offset(100).limit(50).select("p_partkey", "p_name", "p_brand")


@query("WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 3 = 0) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def q_set_overlap(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_suppkey")
    flags = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_suppkey") % 2 == 0).alias("a"), F.bool_or(F.col("l_suppkey") % 3 == 0).alias("b"))
    one = flags.agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("only_a"), F.count_if(F.expr("b AND NOT a")).alias("only_b"))
    return one.unpivot([], ["both", "only_a", "only_b"], "part", "n")


# ---- aggregates


@query("SELECT s_suppkey, count(l_orderkey) AS items, count(l_orderkey) FILTER (l_discount > 0.05) AS discounted FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def q_item_counters(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("items"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))
    return t.supplier.select("s_suppkey").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("discounted", F.lit(0)).alias("discounted"))


@query(sql(*OR) + "SELECT region, nation, count(DISTINCT product) AS skus, count(*) AS offers, max(shipped) AS newest, sum(cents) AS total FROM regional GROUP BY ALL")
def q_source_summary(t: Tables) -> DataFrame:
    return t.regional.groupBy("region", "nation").agg(F.countDistinct("product").alias("skus"), F.count("*").alias("offers"), F.max("shipped").alias("newest"), F.sum("cents").alias("total"))


@query(sql(*OR) + ", x AS (SELECT region, count(DISTINCT product) AS with_price FROM regional GROUP BY region) SELECT region, with_price, (SELECT count(*) FROM products) - with_price AS without_price, round(100.0 * with_price / (SELECT count(*) FROM products), 2) AS coverage FROM x")
def q_coverage(t: Tables) -> DataFrame:
    total = t.products.agg(F.count("*").alias("total"))
    x = t.regional.groupBy("region").agg(F.countDistinct("product").alias("with_price")).join(F.broadcast(total), how="cross")  # one row
    return x.select("region", "with_price", (F.col("total") - F.col("with_price")).alias("without_price"), F.round(100.0 * F.col("with_price") / F.col("total"), 2).alias("coverage"))


@query(sql("products", "offers") + "SELECT product, count(*) AS n, sum(line) AS stock, min(cents) FILTER (line > 1) AS min_price, min(cents) FILTER (line > 1 AND shipped >= '1996-06-01') AS min_fresh, max(shipped) AS latest FROM offers GROUP BY product")
def q_goods_aggregate(t: Tables) -> DataFrame:
    live = F.col("line") > 1
    return t.offers.groupBy("product").agg(F.count("*").alias("n"), F.sum("line").alias("stock"), F.min(F.when(live, F.col("cents"))).alias("min_price"), F.min(F.when(live & (F.col("shipped") >= "1996-06-01"), F.col("cents"))).alias("min_fresh"), F.max("shipped").alias("latest"))


@query("SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT l_suppkey) >= 5")
def q_having_audit(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return x.where("n >= 10 AND suppliers >= 5")


@query("SELECT user_id, event_type, 2 * count(*) AS rows_seen FROM events GROUP BY ALL")
def q_exact_dedup(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type")
    return dedup.exact_dedup(e.unionByName(e), ["user_id", "event_type"])


@query("WITH d AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS previous FROM d) SELECT *, CASE WHEN n < 3 THEN 'too_few_rows' WHEN n < 0.9 * previous THEN 'shrunk' ELSE 'ok' END AS decision FROM p")
def q_snapshot_guard(t: Tables) -> DataFrame:
    d = t.events.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return dedup.snapshot_guard(d, "source", "day", "n", 3, 0.9)


# ---- scalars


@query("SELECT p_partkey, lpad(right(regexp_replace(x, '\\D', '', 'g'), 18), 18, '0') AS sku18, regexp_replace(x, '^0+(.)', '\\1') AS loose, regexp_replace(p_brand || ' ' || p_size, '\\s+', '', 'g') AS external FROM (SELECT *, '00' || p_partkey || '-' || p_size AS x FROM part)")
def q_sku_normalize(t: Tables) -> DataFrame:
    x = F.concat(F.lit("00"), "p_partkey", F.lit("-"), "p_size")
    return t.part.select("p_partkey", text.sku18(F.concat(F.lit("zz9_"), x)).alias("sku18"), text.sku_loose(x).alias("loose"), text.external_sku(F.concat("p_brand", F.lit(" "), "p_size")).alias("external"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}%/.,+-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents")
def q_text_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.text_key(F.col("text")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE trim(p_name) || '|' || trim(p_brand) || '|' || p_size END AS key FROM part")
def q_identity_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.identity_key(F.col("p_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).otherwise(F.lit(" ")), F.col("p_size")).alias("key"))


@query("SELECT p_partkey, p_size || 'mg,' || p_size % 7 || '.5ml' AS units FROM part")
def q_unit_tokens(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), "p_size", F.lit(" MG / "), F.col("p_size") % 7, F.lit(",5 ml tab"))
    return t.part.select("p_partkey", F.array_join(F.filter(text.unit_tokens(name), lambda x: x.rlike("mg$|ml$")), ",").alias("units"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) AS items, len(regexp_extract_all(html, '(?is)<p\\b[^>]*>', 0)) AS paragraphs, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def q_html_cells(t: Tables) -> DataFrame:
    rows = F.regexp_replace("html", r"(?i)<(/?)li\b", "<$1tr")
    return t.pages.select("page_id", F.size(feeds.html_rows(rows)).alias("items"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>"), F.lit(0))).alias("paragraphs"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT event_id, CAST(o_orderdate AS DATE) AS parsed, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS age FROM (SELECT o_orderkey AS event_id, o_orderdate FROM orders)")
def q_date_parse(t: Tables) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = dates.lenient(shown)
    return t.orders.select(F.col("o_orderkey").alias("event_id"), d.alias("parsed"), F.datediff(F.lit("1998-01-01").cast("date"), d).cast("bigint").alias("age"))


@query("SELECT o_orderkey, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01'), 0) AS days FROM orders")
def q_days_old(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.days_old(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")).cast("bigint").alias("days"))


@query("SELECT event_type, max(ts) AS last, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 60 AS stale FROM events GROUP BY 1")
def q_status_stale(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    x = t.events.groupBy("event_type").agg(F.max("ts").alias("last")).join(F.broadcast(now), how="cross")  # one row
    return x.select("event_type", "last", (F.timestamp_diff("SECOND", F.col("last"), F.col("now")) > 60).alias("stale"))


@query("WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)) AS t FROM documents), j AS (SELECT a.doc_id, a.t AS t1, b.t AS t2 FROM w a JOIN w b ON b.doc_id = a.doc_id + 1) SELECT doc_id, CASE WHEN least(len(t1), len(t2)) > 0 THEN round(len(list_intersect(t1, t2)) / least(len(t1), len(t2)), 6) ELSE 0 END AS overlap FROM j")
def q_token_overlap(t: Tables) -> DataFrame:
    ascii_ = F.regexp_replace(F.lower("text"), r"[^0-9a-z]+", " ")
    w = t.documents.select("doc_id", text.tokens(ascii_).alias("t"))
    return w.alias("a").join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id").select("doc_id", F.round(text.token_overlap(F.col("t"), F.col("u")), 6).alias("overlap"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def q_json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query(None)
def q_fuzzy_best(t: Tables) -> DataFrame:
    """The most similar other part of the same brand and size, by gestalt pattern matching."""
    p = t.part.select("p_partkey", "p_name", F.concat_ws("|", "p_brand", "p_size").alias("k"))
    return linkage.most_similar(p, "p_partkey", "p_name", "k").select("p_partkey", "other", "score")
