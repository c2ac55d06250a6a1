"""Exact dedup, best-of dedup and snapshot guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def storage_key(*cs: Column) -> Column:
    """sha256 over the parts, nulls told from blanks."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cs])), 256)


def exact_dedup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key values with ``rows_seen``; the sums combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows_seen"))


def best_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key by the order, which must end in a unique column.

    ``row_number() = 1`` plans as a window group limit: each map task keeps one row a key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def max_per_key(rows: DataFrame, keys: list[str], *score: Column) -> DataFrame:
    """The row of the greatest score tuple per key, as one aggregation with map-side combining."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*score)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def snapshot_guard(counts: DataFrame, key: str, seq: str, n: str, least: int = 100, ratio: float = 0.5) -> DataFrame:
    """Whether each snapshot may replace the one before: enough rows, and enough of the former number."""
    before = F.lag(n).over(Window.partitionBy(key).orderBy(seq))
    why = F.when(F.col(n) < least, "too_few_rows").when(F.col(n) < ratio * F.col("previous"), "shrunk").otherwise("ok")
    return counts.withColumn("previous", before).withColumn("decision", why)


def publish(new: DataFrame, path: str, source_key: str, previous_rows: int | None, least: int = 100, ratio: float = 0.5) -> int:
    """Replace the partitions of the sources in ``new`` after the guards; the files of other sources stay."""
    n = new.count()
    if n < least:
        raise ValueError(f"snapshot of {n} rows is below {least}")
    if previous_rows and n < ratio * previous_rows:
        raise ValueError(f"snapshot of {n} rows is below {ratio:.0%} of {previous_rows}")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source_key).parquet(path)
    return n
