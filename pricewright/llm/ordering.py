"""Running totals over an order of all rows, without a group in one task; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stage


def running(rows: DataFrame, by: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` and, for each of ``sums``, its total over the rows of the same group (``by``) that come before in ``order``.

    Rows are range-partitioned by group and order. A window over the partitions' own totals, a row per partition
    and group, gives what lies before a partition; a window inside gives the rest. So a group that
    holds all rows is still dealt to all tasks, if ``order`` tells its rows apart.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in by]
    dealt = rows.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(partitions(spark), *keys, *order)
    dealt = stage(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    held = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    so_far = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{k}").over(so_far), F.lit(0)).alias(f"_base_{k}") for k in sums])
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    return local.join(base, same).select(*rows.columns, *[(F.col(f"_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])
