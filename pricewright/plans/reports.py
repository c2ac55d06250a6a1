"""Reports and audits: queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports, uploads
from .catalog import query
from .tables import Tables, sql


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 2 = 0 THEN 'k' || l_suppkey IN (SELECT 'k' || s_suppkey FROM supplier WHERE s_acctbal > 0) ELSE l_partkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) END")
def q_scoped_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("k"), "l_suppkey")).otherwise("").alias("key"), F.col("l_partkey").alias("other"))
    wanted = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("k"), "s_suppkey").alias("key"), F.col("s_nationkey").alias("other"))
    return reports.scoped(rows, wanted, "key", "other").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey AS k, count(l_orderkey) AS items, count(*) FILTER (l_quantity > 48) AS counted, CASE WHEN count(l_orderkey) = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'failed_empty' ELSE 'empty' END WHEN s_suppkey % 3 > 0 THEN 'not_assigned' END AS hidden FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND s_suppkey % 5 > 0 GROUP BY s_suppkey")
def q_lists_with_counts(t: Tables) -> DataFrame:
    k = F.col("k")
    items = t.lineitem.select(F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).otherwise(-1).alias("k"), "l_quantity")  # items of no list are there too
    x = reports.item_counts(t.supplier.select(F.col("s_suppkey").alias("k")), items, "k", F.col("l_quantity") > 48)
    return x.select("k", "items", "counted", reports.hidden_reason(F.col("items"), F.when(k % 2 == 0, "Failed").otherwise("ok"), k % 3 == 0).alias("hidden"))


_PV = sql("products", "offers", "regional") + ", pv AS (SELECT product, nation, count(*) AS n, max(shipped) AS day, unnest([10, 20, 30, 40, 60]) AS percentile, round(unnest(quantile_cont(cents, [0.1, 0.2, 0.3, 0.4, 0.6])) * 100) / 100 AS value FROM regional GROUP BY product, nation) "


def _values(t: Tables) -> DataFrame:
    v = t.regional.groupBy("product", F.col("nation").alias("source")).agg(F.percentile("cents", F.array(*[F.lit(p / 100) for p in (10, 20, 30, 40, 60)])).alias("v"), F.count("*").alias("n"), F.max("shipped").alias("day"))
    return v.select("product", "source", "n", "day", F.posexplode("v").alias("i", "value")).select("product", "source", "n", "day", F.element_at(F.array(*map(F.lit, (10, 20, 30, 40, 60))), F.col("i") + 1).alias("percentile"), (F.round(F.col("value") * 100) / 100).alias("value"))


@query(_PV + "SELECT nation AS source, count(DISTINCT product) AS skus, sum(n) AS prices, max(day) AS updated FROM pv GROUP BY nation")
def q_percentile_groups(t: Tables) -> DataFrame:
    return reports.percentile_groups(_values(t), ["source"], "product", "n", "day")


@query(_PV + "SELECT product, round(quantile_cont(value, 0.1) FILTER (percentile = 10), 3) AS p10, round(quantile_cont(value, 0.4) FILTER (percentile = 40), 3) AS p40, count(DISTINCT nation) AS sources FROM pv GROUP BY product")
def q_percentile_browser(t: Tables) -> DataFrame:
    return reports.browser(_values(t), "product", (10, 40)).select("product", F.round("p10", 3).alias("p10"), F.round("p40", 3).alias("p40"), "sources")


@query("WITH f AS (SELECT p_partkey, bool_or(l_tax > 0.07) AS pos, count(l_orderkey) > 0 AS a, p_size % 2 = 0 AS st FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 30 GROUP BY p_partkey, p_size) SELECT count(*) AS products, count(*) FILTER (a) AS priced, count(*) FILTER (pos) AS positive, count(*) FILTER (st) AS stored, count(*) FILTER (pos AND NOT st) AS lost FROM f")
def q_coverage_funnel(t: Tables) -> DataFrame:
    prices = t.lineitem.where("l_quantity > 30").select(F.col("l_partkey").alias("product"), (F.col("l_tax") - 0.07).alias("price")).withColumn("price", F.when(F.col("price") > 1e-9, F.col("price")).otherwise(0))
    return reports.coverage_funnel(t.part.select(F.col("p_partkey").alias("product")), prices, t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("product")), "product")


@query(sql("products", "offers", "regional") + "SELECT product, nation, source, cents AS price FROM regional WHERE product < 4 ORDER BY cents, source LIMIT 1000")
def q_percentile_trace(t: Tables) -> DataFrame:
    return reports.trace(t.regional.withColumnRenamed("cents", "price"), F.col("product") < 4, ["product", "nation"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_nationkey < 9 THEN 'match' ELSE 'mismatch' END WHEN s_suppkey % 4 = 1 THEN CASE WHEN s_nationkey IN (1, 2, 3) THEN 'match' ELSE 'mismatch' END WHEN s_suppkey % 4 = 2 THEN CASE WHEN s_nationkey < 15 THEN 'match' ELSE 'unknown' END ELSE 'unknown' END AS verdict FROM supplier")
def q_region_verdict(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    city = F.when(k == 0, F.when(n < 9, " Алматы ").otherwise("Астана"))
    address = F.when(k == 2, F.when(n < 15, "г. АЛМАТЫ, 5").otherwise("Астана"))
    return t.supplier.select("s_suppkey", reports.region_verdict(city, F.lit(None).cast("string"), F.when(k == 1, n.cast("int")), address, F.lit("алматы"), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("verdict"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) AS total, count(*) FILTER (o_orderstatus IN ('F', 'O')) = count(*) AS accounted FROM orders GROUP BY 1")
def q_outcome_accounting(t: Tables) -> DataFrame:
    return reports.outcomes(t.orders, "o_custkey", "o_orderstatus", ("F", "O"))


@query("SELECT l_suppkey, sum(l_quantity) AS seconds, count(*) AS runs FROM lineitem GROUP BY 1 ORDER BY seconds DESC, l_suppkey LIMIT 10")
def q_slowest(t: Tables) -> DataFrame:
    return reports.slowest(t.lineitem, "l_suppkey", "l_quantity")


@query("WITH c AS (SELECT c_custkey AS k, count(o_orderkey) AS products, count(*) FILTER (o_totalprice > 450000) AS costs, max(CAST(o_orderdate AS DATE)) AS updated FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_nationkey > 2 GROUP BY 1) SELECT k, CASE WHEN products = 0 THEN 'no_products' WHEN costs = 0 THEN 'no_costs' WHEN date_diff('day', updated, DATE '1998-06-01') > 100 THEN 'stale' ELSE 'ready' END AS state FROM c")
def q_readiness(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.where("c_nationkey > 2").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("products"), F.count_if(F.col("o_totalprice") > 450000).alias("costs"), F.max(F.col("o_orderdate").cast("date")).alias("updated"))
    return reports.readiness(t.customer.select(F.col("c_custkey").alias("k")).join(o, "k", "left"), F.lit("1998-06-01").cast("date"), 100).select("k", "state")


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority = '1-URGENT' AS sel, o_orderkey % 7 AS c FROM orders), n AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, bool_or(sel) AS chosen, arg_max(c, (o_orderdate, o_orderkey)) FILTER (sel) AS c FROM r GROUP BY 1) SELECT o_orderkey, chosen AND o_orderkey = newest AS selected, CASE WHEN chosen AND o_orderkey = newest THEN n.c END AS coefficient FROM r JOIN n USING (o_custkey)")
def q_latest_selection(t: Tables) -> DataFrame:
    r = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("selected"), (F.col("o_orderkey") % 7).alias("coefficient"))
    return reports.latest_selection(r, ["o_custkey"], "o_orderkey", "o_orderdate")


@query("WITH r AS (SELECT o_custkey AS product, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 END AS b, o_orderkey % 50 AS rating, o_orderdate AS u, o_orderkey AS id FROM orders) SELECT product, arg_max(rating, (u, id)) FILTER (b IS NULL) AS global_rating, arg_max(rating, (u, id)) FILTER (b = 1) AS local_rating FROM r WHERE b IS NULL OR b = 1 GROUP BY product")
def q_ratings(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return reports.ratings(t.orders.select(F.col("o_custkey").alias("product"), F.when(k % 3 > 0, k % 3).alias("branch"), (k % 50).alias("rating"), F.col("o_orderdate").alias("updated"), k.alias("id")), "product", F.lit(1))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def q_recent_runs(t: Tables) -> DataFrame:
    return reports.recent(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT l_suppkey, array_to_string(list(f ORDER BY o, f), ',') AS aliases FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS f, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def q_merged_aliases(t: Tables) -> DataFrame:
    x = reports.merged_aliases(t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("f"), "l_orderkey"), ["l_suppkey"], "f", "l_orderkey")
    return x.select("l_suppkey", F.array_join("aliases", ",").alias("aliases"))


@query(sql("products", "offers", "regional") + "SELECT product, 'region ' || region AS title, min(cents * (1 + nation % 2)) AS price FROM regional GROUP BY ALL")
def q_prices_by_column(t: Tables) -> DataFrame:
    s = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    columns = s.select(F.col("s_suppkey").alias("source"), F.concat(F.lit("region "), "n_regionkey").alias("title"), (F.col("n_nationkey") % 2 + 1).alias("coefficient"))
    return reports.prices_by_column(t.offers.withColumnRenamed("cents", "price"), columns, "product")


@query("SELECT p_partkey, CASE WHEN p_size * 0.5 >= 20 THEN p_size * 0.5 WHEN (p_size + 10) * 0.5 >= 20 THEN (p_size + 10) * 0.5 ELSE 20 END AS price FROM part")
def q_baseline_price(t: Tables) -> DataFrame:
    d = "decimal(18,4)"
    bend = F.array(F.struct(F.lit(0).cast(d).alias("price_from"), F.lit(50).cast("decimal(18,6)").alias("percent")))
    got = reports.baseline_price(F.array(F.col("p_size").cast(d), (F.col("p_size") + 10).cast(d)), F.lit(20).cast(d), bend, F.lit(0).cast("decimal(18,6)"))
    return t.part.select("p_partkey", got.cast("double").alias("price"))


@query("SELECT n_nationkey AS format_id, n_name AS format, r_name AS holding, s_name AS party, NULL AS point FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3 ORDER BY n_nationkey, r_name NULLS FIRST, s_name LIMIT 300")
def q_contractors(t: Tables) -> DataFrame:
    links = t.supplier.select(F.col("s_nationkey").alias("format_id"), F.col("s_suppkey").alias("party_id"), F.lit(0).alias("point_id"))
    formats = t.nation.select(F.col("n_nationkey").alias("format_id"), F.col("n_name").alias("format"), F.col("n_regionkey").alias("holding_id"))
    holdings = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("holding_id"), F.col("r_name").alias("holding"))
    points = t.spark.createDataFrame([], "point_id int, point string")
    return reports.contractors(links, formats, holdings, t.supplier.select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party")), points)


@query("SELECT s_suppkey AS k, count(l_orderkey) AS items, count(*) FILTER (l_quantity > 49) AS counted, CASE WHEN count(l_orderkey) = 0 THEN 'no_items' WHEN s_suppkey % 5 = 1 THEN 'no_assignment' WHEN s_suppkey % 5 = 2 THEN 'inactive' WHEN count(*) FILTER (l_quantity > 49) = 0 THEN 'nothing_matched' ELSE 'in_use' END AS verdict FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND s_suppkey % 5 > 0 GROUP BY s_suppkey")
def q_feed_diagnostics(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("k"))
    items = t.lineitem.select(F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).otherwise(-1).alias("k"), F.when(F.col("l_quantity") > 49, F.col("l_partkey")).alias("product"))
    return reports.diagnostics(s, items, s.where("k % 5 <> 1").withColumn("is_active", F.col("k") % 5 != 2), "k")


@query("SELECT count(*) AS planned, count(*) - count(DISTINCT o_custkey) AS duplicates, count(DISTINCT o_custkey) AS selected FROM orders")
def q_feed_inventory(t: Tables) -> DataFrame:
    return reports.inventory(t.orders, "o_custkey", F.col("o_orderkey"))


@query("WITH x AS (SELECT o_custkey AS k, o_orderkey % 11 = 0 AS e, o_orderkey % 7 = 0 AS i, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS f FROM orders) SELECT count(*) AS total_rows, count(*) FILTER (e) AS empty_rows, count(*) FILTER (NOT e AND i) AS invalid_rows, count(*) FILTER (NOT e AND NOT i AND NOT f) AS not_found, count(DISTINCT CASE WHEN NOT e AND NOT i AND f THEN k END) AS processed, count(*) FILTER (NOT e AND NOT i AND f) - count(DISTINCT CASE WHEN NOT e AND NOT i AND f THEN k END) AS duplicates FROM x")
def q_import_summary(t: Tables) -> DataFrame:
    known = t.customer.where("c_acctbal > 0").select("c_custkey", F.lit(True).alias("known"))
    x = t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return reports.import_summary(x, "o_custkey", F.coalesce("known", F.lit(False)), F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 11 == 0)


@query("WITH n AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS run FROM orders GROUP BY 1) SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders JOIN n USING (o_custkey) WHERE o_orderpriority = run GROUP BY ALL")
def q_latest_run(t: Tables) -> DataFrame:
    x = reports.latest_run_rows(t.orders.select("o_custkey", "o_orderpriority", "o_orderdate"), "o_custkey", "o_orderpriority", "o_orderdate")
    return x.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))


# ---- uploads


@query("WITH new AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1), old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 0) SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'untouched' WHEN n.v = o.v THEN 'unchanged' ELSE 'updated' END AS change FROM new n FULL JOIN old o ON n.k = o.k")
def q_upsert(t: Tables) -> DataFrame:
    old = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return uploads.upsert(old, t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey"), ["k"], F.desc("o_orderkey"))


@query("WITH b AS (SELECT l_suppkey AS branch FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity = 50 AND l_linenumber = 7) = 0) SELECT l_suppkey AS branch, l_partkey AS product, max(l_quantity) AS v FROM lineitem WHERE l_suppkey IN (SELECT branch FROM b) GROUP BY ALL UNION ALL SELECT s_suppkey, -1, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT branch FROM b)")
def q_snapshot_import(t: Tables) -> DataFrame:
    """A branch's snapshot is replaced as a whole, unless one of its new rows is bad."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("product")).agg(F.max("l_quantity").alias("v"), F.bool_or((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7)).alias("bad"))
    old = t.supplier.select(F.col("s_suppkey").alias("branch"), F.lit(-1).cast("bigint").alias("product"), F.lit(0.0).alias("v"))
    return uploads.replace_snapshots(old, rows, "branch", F.col("bad")).select("branch", "product", "v")


@query("SELECT o_custkey AS sku, min(o_orderkey) AS rank FROM orders WHERE o_orderkey > 0 AND o_custkey > 0 GROUP BY 1")
def q_rating_import(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("rank"), F.col("o_custkey").cast("string").alias("sku"), "o_orderkey")
    return uploads.ratings(rows.where("sku <> '0'"), "o_orderkey").select(F.col("sku").cast("bigint").alias("sku"), "rank")


@query("WITH v AS (SELECT o_custkey AS k, o_orderkey AS r, o_orderkey % 9 AS p FROM orders) SELECT k AS sku, arg_max(p, r) AS price FROM v WHERE p > 0 GROUP BY k")
def q_manual_list(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat(F.lit(" "), "o_custkey").alias("sku"), F.concat(F.col("o_orderkey") % 9, F.lit(",00 тг")).alias("price"), F.col("o_orderkey").alias("row"))
    return uploads.manual_list(rows, "row").select(F.col("sku").cast("bigint").alias("sku"), F.col("price").cast("double").alias("price"))


@query("SELECT r_regionkey AS rule, n_nationkey AS cost_from, n_regionkey AS percent, 'copy-' || r_regionkey AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_copy_rule(t: Tables) -> DataFrame:
    rules = t.region.select(F.col("r_regionkey").alias("rule"), F.concat(F.lit("c"), "r_regionkey").alias("code"))
    rows = t.nation.select(F.col("n_regionkey").alias("rule"), F.col("n_nationkey").alias("cost_from"), F.col("n_regionkey").alias("percent"))
    return uploads.copy_rules(rules, rows, "rule", F.concat(F.lit("copy-"), F.col("rule"))).select("rule", "cost_from", "percent", "code")


@query("SELECT o_custkey AS product, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS goods_id FROM orders GROUP BY 1 UNION ALL SELECT -1, -1")
def q_learned_links(t: Tables) -> DataFrame:
    """Learned links never overwrite what is there; of new ones the first stays."""
    old = t.spark.createDataFrame([(-1, -1)], "product bigint, goods_id bigint")
    return uploads.insert_missing(old, t.orders.select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("goods_id"), "o_orderdate"), ["product"], F.asc("o_orderdate"), F.asc("goods_id"))
