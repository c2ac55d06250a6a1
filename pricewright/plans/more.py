"""Further queries: assignments, carry-over, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assignments, dedup
from .catalog import query
from .tables import Tables, sql


@query("SELECT f.format, s.source, CASE WHEN e.a IS NULL THEN 'create' WHEN e.a THEN 'reuse' ELSE 'reactivate' END AS action FROM (SELECT DISTINCT o_orderpriority AS format FROM orders) f CROSS JOIN (SELECT n_nationkey AS source FROM nation) s LEFT JOIN (SELECT o_orderpriority AS format, n_nationkey AS source, n_nationkey % 2 = 0 AS a FROM (SELECT DISTINCT o_orderpriority FROM orders), nation WHERE n_regionkey <> 2) e USING (format, source)")
def q_propagate_assignments(t: Tables) -> DataFrame:
    formats = t.orders.select(F.col("o_orderpriority").alias("format")).distinct()
    sources = t.nation.select(F.col("n_nationkey").alias("source"))
    existing = formats.join(F.broadcast(t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("source"))), how="cross").withColumn("is_active", F.col("source") % 2 == 0)  # 25 nations
    return assignments.propagate(existing, formats, sources)


@query("SELECT coalesce(e.k, s.k) AS k, coalesce(e.c, 1.0) AS coefficient, s.k IS NOT NULL AS is_active, CASE WHEN e.k IS NULL THEN 'inserted' WHEN s.k IS NULL THEN 'deactivated' ELSE 'kept' END AS change FROM (SELECT s_suppkey AS k, s_suppkey % 5 + 0.5 AS c FROM supplier WHERE s_acctbal > 0) e FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 12) s ON e.k = s.k")
def q_reconcile_assignments(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("k"), "s_acctbal", "s_nationkey")
    e = s.where("s_acctbal > 0").select("k", (F.col("k") % 5 + F.lit(0.5)).alias("coefficient"))
    return assignments.reconcile(e, s.where("s_nationkey < 12").select("k"), ["k"], F.lit(1.0))


@query("WITH n AS (SELECT o_orderkey, 'c' || o_custkey AS k1, 'p' || o_orderpriority AS k2 FROM orders), o AS (SELECT 'c' || c_custkey AS k, min(c_nationkey) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT 'p1-URGENT', 99) SELECT o_orderkey, coalesce(a.v, b.v) AS v FROM n LEFT JOIN o a ON a.k = k1 LEFT JOIN o b ON b.k = k2")
def q_carry_over_matches(t: Tables) -> DataFrame:
    n = t.orders.select("o_orderkey", F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("p"), "o_orderpriority")).alias("keys"))
    o = t.customer.where("c_acctbal > 0").select(F.array(F.concat(F.lit("c"), "c_custkey")).alias("old_keys"), F.col("c_nationkey").cast("bigint").alias("v"))
    one = t.spark.createDataFrame([(["p1-URGENT"], 99)], "old_keys array<string>, v bigint")
    return assignments.carry_over(n, o.unionByName(one), (F.col("keys"), F.col("old_keys")), "v", "o_orderkey").select("o_orderkey", "v")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 THEN 'account:' || s_nationkey || ':plk:' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'web:' || s_suppkey ELSE 'name:' || lower(trim(s_name)) END AS source_key FROM supplier")
def q_source_key(t: Tables) -> DataFrame:
    ext = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string"))
    account = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string"))
    return t.supplier.select("s_suppkey", assignments.source_key(F.lit("Web"), account, ext, F.col("s_name")).alias("source_key"))


@query("WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) SELECT s_suppkey, CASE WHEN coalesce(n, 0) > 0 THEN 'populated' WHEN s_suppkey % 3 = 0 THEN 'failed_empty' WHEN s_suppkey % 3 = 1 THEN 'empty_success' ELSE 'placeholder' END AS state FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey")
def q_source_visibility(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    status = F.when(F.col("s_suppkey") % 3 == 0, "failed").when(F.col("s_suppkey") % 3 == 1, "success").otherwise("new")
    return t.supplier.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", assignments.visibility(status, F.coalesce("n", F.lit(0))).alias("state"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS winner FROM orders")
def q_merge_duplicates(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return assignments.merge_duplicates(o, ["o_custkey", "o_orderpriority"], "o_orderkey", F.desc("o_orderdate"), F.asc("o_orderkey"))


@query("WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus <> 'F') SELECT f, n, 'template' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT f, n, 'applied' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def q_rule_application(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_linestatus", F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return assignments.applied_differs(x.where("l_linestatus = 'F'").drop("l_linestatus"), x.where("l_linestatus <> 'F'").drop("l_linestatus"))


@query("WITH u AS (SELECT l_orderkey AS k, l_suppkey % 4 AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS s FROM lineitem) SELECT k, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' WHEN count(DISTINCT s) = 2 THEN 'agreed' ELSE 'single' END AS status FROM u GROUP BY k")
def q_reference_mapping(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 4).alias("v"), "l_returnflag")
    return assignments.reference_ids(x.where("l_returnflag = 'R'"), x.where("l_returnflag <> 'R'"), "k", "v")


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_returned, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS has_discount, count(DISTINCT l_partkey) AS skus FROM lineitem GROUP BY 1")
def q_browser_flags(t: Tables) -> DataFrame:
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return t.lineitem.groupBy("l_suppkey").agg(flag(F.col("l_returnflag") == "R").alias("has_returned"), flag(F.col("l_discount") > 0.09).alias("has_discount"), F.countDistinct("l_partkey").alias("skus"))


@query("SELECT l_suppkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, min(l_partkey) AS lo FROM lineitem GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, l_suppkey LIMIT 20")
def q_stage_audit(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.min("l_partkey").alias("lo"))
    return x.where("n >= 10").orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name ILIKE '%00%' AND c_acctbal > 0 ORDER BY c_nationkey NULLS LAST, c_custkey LIMIT 40")
def q_search_items(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_name").ilike("%00%") & (F.col("c_acctbal") > 0)).orderBy(F.asc_nulls_last("c_nationkey"), "c_custkey").limit(40).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_mktsegment, count(o_orderkey) AS n, round(100.0 * count(o_orderkey) / (SELECT count(*) FROM orders), 2) AS share FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q_zone_shares(t: Tables) -> DataFrame:
    n = t.orders.agg(F.count("*").alias("all"))
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(n), how="cross").select("c_mktsegment", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("share"))  # one row


@query("SELECT l_suppkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey, l_orderkey, l_linenumber) <= 3")
def q_top_candidates(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_orderkey", "l_linenumber")
    return t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_partkey", "l_quantity")


@query(sql("products", "offers") + "SELECT product, count(*) AS rows_seen, min(cents) AS lo, max(cents) AS hi, count(DISTINCT cents) AS prices FROM offers GROUP BY product")
def q_multi_price_audit(t: Tables) -> DataFrame:
    return t.offers.groupBy("product").agg(F.count("*").alias("rows_seen"), F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.countDistinct("cents").alias("prices"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def q_skip_unchanged(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    x = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n")).join(F.broadcast(now), how="cross")  # one row
    return x.where(F.col("last") < F.col("now") - F.expr("INTERVAL 1 DAY")).select("user_id", "n")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def q_claim_duplicates(t: Tables) -> DataFrame:
    return dedup.best_per_key(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], F.asc("o_orderkey"))
