"""Tables that change as a whole: data are written aside, checked, and then switched to by one new manifest.

A table is a folder with ``data`` (a folder per batch) and ``manifest`` (a file per version). A version says for each source
which batch holds its rows. Readers take the newest manifest, so they see a version or the next, never
something between; a batch that fails leaves nothing but unread files, which go at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(ValueError):
    """A batch that may not be published; the table is as it was."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table, oldest first."""
    at, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    return sorted(int(name[:-5]) for name in (s.getPath().getName() for s in fs.listStatus(at)) if name[:-5].isdigit() and name.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version (the newest) consists of; of a table without one: nothing, as version 0."""
    known = versions(spark, path)
    if not known and version is None:
        return {"version": 0, "sources": {}, "applied": {}, "notes": {}}
    at, fs = _fs(spark, f"{path}/manifest/{known[-1] if version is None else version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, content: dict) -> None:
    """Put the manifest in its place, complete or not at all; who comes second with a version is rejected."""
    jvm, at = spark._jvm, f"{path}/manifest/{content['version']:012d}.json"
    aside, fs = _fs(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(at)), no_overwrite)
    except Exception as e:
        fs.delete(aside, False)
        raise Rejected(f"version {content['version']} was published by another batch") from e


def publish(
    new: DataFrame, path: str, source_key: str, batch: tuple[str, int], least: int = 100, ratio: float = 0.5,
    checks: Iterable[Callable[[DataFrame], DataFrame]] = (), drop: Iterable[str] = (), notes: dict[str, str] | None = None,
) -> int:
    """Replace the rows of all sources in ``new``, or of none of them; returns the version.

    A batch (name, number) is applied once: a number not above the last of its name changes nothing, so replays are safe.
    All sources must have ``least`` rows and ``ratio`` of what they had, no row may lack its source, and each of ``checks``, given the
    written rows, must return no row: else ``Rejected`` is raised, with all reasons, and the former version stays the one that is read.
    ``drop``: sources that go; ``notes``: a text per source that the manifest keeps. The manifest has an entry per source, so
    sources should be feeds or scopes, not rows.
    """
    spark = new.sparkSession
    now = manifest(spark, path)
    name, number = batch
    if now["applied"].get(name, -1) >= number:
        return now["version"]
    folder = f"data/{uuid.uuid4().hex}"
    aside, fs = _fs(spark, f"{path}/{folder}")
    try:
        new.withColumn("_source", F.col(source_key).cast("string")).write.partitionBy("_source").parquet(f"{path}/{folder}")
        written = spark.read.schema(new.schema).parquet(f"{path}/{folder}")
        counts = {r[0]: r[1] for r in written.groupBy(F.col(source_key).cast("string")).count().collect()}  # a row per source
        why = ["rows without a source"] if None in counts else []
        for source, n in sorted((s, n) for s, n in counts.items() if s is not None):
            before = now["sources"].get(source, {}).get("rows")
            if n < least:
                why.append(f"{source}: {n} rows are below {least}")
            elif before and n < ratio * before:
                why.append(f"{source}: {n} rows are below {ratio:.0%} of {before}")
        for check in checks:
            bad = check(written).limit(3).collect()
            if bad:
                why.append(f"{getattr(check, '__name__', 'check')}: {[tuple(r) for r in bad]}")
        if why:
            raise Rejected("; ".join(why))
        sources = {s: v for s, v in now["sources"].items() if s not in set(drop)}
        sources |= {s: {"folder": folder, "rows": n} for s, n in counts.items()}
        kept = {s: v for s, v in now["notes"].items() if s not in set(drop)} | (notes or {})
        _switch(spark, path, {"version": now["version"] + 1, "sources": sources, "applied": {**now["applied"], name: number}, "notes": kept})
    except Exception:
        fs.delete(aside, True)
        raise
    return now["version"] + 1


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest); folders of batches are pruned by source, down to single partitions."""
    held: dict[str, list[str]] = {}
    for source, v in manifest(spark, path, version)["sources"].items():
        held.setdefault(v["folder"], []).append(source)
    out = None
    for folder, sources in sorted(held.items()):
        part = spark.read.schema(f"{schema if isinstance(schema, str) else _ddl(schema)}, _source string").parquet(f"{path}/{folder}").where(F.col("_source").isin(sources)).drop("_source")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
