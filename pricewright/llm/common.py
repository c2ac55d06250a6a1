"""Shared plumbing: staged tables in the cluster's shared folder, column guards, Arrow iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Bytes of text that one vectorised step handles at once; a longer single text is handled alone.
STEP_BYTES = 1_000_000
#: Rows of one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 250


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a local session gets a temporary one, on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/pricewright-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, which the driver's file system deletes when the application ends."""
    at = f"{shared_dir(spark)}/pricewright-{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The table survives the loss of any executor and prunes columns when it is read.
    """
    spark = df.sparkSession
    at = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def small(staged: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it has ``most`` rows at most, of a few numbers each; else left to a shuffled join.

    Rows with arrays, texts or bytes are of no known size and are never marked.
    """
    plain = all(isinstance(f.dataType, (NumericType, BooleanType)) for f in staged.schema)
    return F.broadcast(staged) if plain and staged.count() <= most else staged


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def steps(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Encode texts to UTF-8 and deal them out in runs of at most ``limit`` bytes (one text at least)."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def docs_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with those made here."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
