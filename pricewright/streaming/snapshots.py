"""Whole snapshots delivered as they land, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sinks import versions


def deliver(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], source_key: str = "source_key") -> StreamingQuery:
    """Read what has landed, transform it and replace the partitions of the sources that it holds.

    ``AvailableNow`` with a checkpoint: files count once, and a batch that is
    repeated after a failure overwrites the same partitions with the same rows.
    """

    def replace(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source_key).parquet(target)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver_versions(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], source_key: str = "source_key", **guards) -> StreamingQuery:
    """As ``deliver``, into a table of versions: a micro-batch replaces all its sources at once after the guards of ``versions.publish``, or none.

    A batch that is repeated after a failure is applied once. One that is rejected ends the stream with the reasons; the version before stays the one that is read.
    """

    def replace(batch: DataFrame, number: int) -> None:
        rows = transform(batch)
        if not rows.isEmpty():
            versions.publish(rows, target, source_key, (f"stream {checkpoint}", number), **guards)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(jobs: DataFrame, heartbeat: str, as_of, seconds: int) -> DataFrame:
    """Running jobs whose heartbeat is older than ``seconds`` at ``as_of``."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(heartbeat).cast("timestamp"))
    return jobs.where(F.col("status") == "running").withColumn("age", age).where(F.col("age") > seconds)


def fingerprint(rows: DataFrame, keys: list[str]) -> str:
    """One hash over rows whatever their order: sums of row hashes, so that no task sees them all."""
    h = F.xxhash64(*keys)
    r = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(7)).cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()
