"""Whole batches and results by scope: queries over tables that they publish themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental
from ..session import scratch
from ..sinks import versions
from .catalog import query
from .tables import Tables, sql


@query("SELECT o_orderkey, o_orderpriority AS source, CASE WHEN o_orderpriority < '3' THEN 2 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 2 AS version FROM orders")
def q_versioned_snapshots(t: Tables) -> DataFrame:
    """Orders by priority: a batch of all, one that replaces two sources, a replay of it, and two that are rejected as a whole."""
    at, negative = scratch(t.spark, "orders"), lambda df: df.where("cents < 0")
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("source"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    versions.publish(rows, at, "source", ("orders", 0), 1, checks=[negative])
    urgent = rows.where("source < '3'")
    versions.publish(urgent.withColumn("cents", 2 * F.col("cents")), at, "source", ("orders", 1), 1, checks=[negative])
    versions.publish(urgent, at, "source", ("orders", 1), 1)
    for bad in (rows.withColumn("cents", F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(0)), rows.where(F.when(F.col("source") > "4", F.col("o_orderkey") % 10 == 0).otherwise(True))):
        try:
            versions.publish(bad, at, "source", ("orders", 2), 1, checks=[negative])
            raise AssertionError("a bad batch was published")
        except versions.Rejected:
            pass
    return versions.read(t.spark, at, rows.schema).withColumn("version", F.lit(versions.manifest(t.spark, at)["version"]))


@query(sql("products", "offers", "regional") + "SELECT nation, quantile_cont(cents + CASE WHEN nation % 5 = 0 THEN 1 ELSE 0 END, 0.5) AS median, count(*) AS prices, CASE WHEN nation % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM regional GROUP BY nation")
def q_incremental_percentiles(t: Tables) -> DataFrame:
    """Medians by nation, and again when the prices of some nations have changed: those alone are computed."""
    at = scratch(t.spark, "percentiles")
    before = t.regional.select("nation", "cents")
    after = before.withColumn("cents", F.col("cents") + F.when(F.col("nation") % 5 == 0, 1).otherwise(0))
    compute = lambda df: df.groupBy("nation").agg(F.percentile("cents", F.lit(0.5)).alias("median"), F.count("*").alias("prices"))
    incremental.refresh(lambda: before, "nation", ["cents"], compute, at, 0)
    incremental.refresh(lambda: after, "nation", ["cents"], compute, at, 1)
    state = incremental.changed(incremental.fingerprints(after, "nation", "cents"), incremental.fingerprints(before, "nation", "cents"))
    return versions.read(t.spark, at, "nation int, median double, prices long").join(state.select(F.col("scope").cast("int").alias("nation"), "state"), "nation")
