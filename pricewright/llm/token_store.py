"""Content-addressed store of token ids: chunks cut by a rolling hash, kept once, recipes and Merkle roots."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, partitions, shared_path, short_batches
from .hashing import mix
from .token_words import STEP, forget_words, tokenizers_memo

#: Ids that the rolling hash sees; mean, least and largest chunk in ids.
WINDOW, MEAN, LEAST, MOST = 8, 256, 64, 1024
_MIXED = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)).astype(np.uint32)
_POWERS = [np.uint32(pow(0x9E3779B1, j + 1, 1 << 32)) for j in range(WINDOW)]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last ``WINDOW`` ids has zero high bits, within the size limits."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = _MIXED[ids] if len(ids) == 0 or ids.max() < len(_MIXED) else mix(ids.astype(np.uint64) + np.uint64(1)).astype(np.uint32)
    h = np.zeros(n, np.uint32)
    for j, m in enumerate(_POWERS):
        h[j:] += g[: n - j] * m
    # the high bits depend on all ids of the window
    at = (np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1).tolist()
    out, last = [], 0
    for c in [*at, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n and c > last:
            out.append(c)
            last = c
    return out


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\1" + leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_STAGED = "d long, r long, n long, digests array<binary>, ends array<int>, z binary"
#: Rows whose texts are encoded together.
TOGETHER = 4_000
#: Documents of a shard whose roots are hashed together, so that no group grows with the shard.
BLOCK = 4096
_MANIFEST = "shard int, n_docs long, n_tokens long, start long, root binary"
_STORED = "d long, r long, shard int, block int, pos long, n long, root binary, digests array<binary>, ends array<int>, own binary, own_index array<int>, given array<int>, taken array<struct<i:int,r:long,j:int>>"


#: Files hold ids that are compressed by document already: the codec's small contexts do, and a writer's row group is bounded.
_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(16 << 20)}


def _short_reads(spark: SparkSession) -> None:
    """A scan holds few rows at once too, as they hold whole texts or all their ids."""
    short_batches(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def _stage(df: DataFrame, what: str) -> DataFrame:
    at = shared_path(df.sparkSession, what)
    df.write.options(**_FILES).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches whose texts are encoded together: ``STEP`` bytes, or ``TOGETHER`` rows, or one batch beyond."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        more = batch.column(2).nbytes
        if held and (size + more > STEP or sum(b.num_rows for b in held) + batch.num_rows > TOGETHER):
            yield held
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield held


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(batches):
        memo, squeeze = tokenizers_memo(tokenizer), zstandard.ZstdCompressor(level=1)
        tail = np.asarray([end_id], "<u4").tobytes()
        for some in _runs(batches):
            rows = []
            for raw in memo.texts([t for b in some for t in b.column(2).to_pylist()]):
                raw += tail
                ids = np.frombuffer(raw, "<u4")
                ends = cuts(ids)
                rows.append((len(ids), [digest(raw[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)], ends, squeeze.compress(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + raw)))
            n, g, e, z = zip(*rows)
            d, r = (pa.concat_arrays([b.column(c) for b in some]) for c in range(2))
            yield pa.RecordBatch.from_arrays([d, r, pa.array(n, pa.int64()), pa.array(g, pa.list_(pa.binary())), pa.array(e, pa.list_(pa.int32())), pa.array(z, pa.binary())], ["d", "r", "n", "digests", "ends", "z"])

    return docs.mapInArrow(run, _STAGED)


def _raw(z: bytes) -> bytes:
    """Back to uint32; two-byte ids make an even number of bytes, four-byte ids have a byte before them."""
    raw = zstandard.ZstdDecompressor().decompress(z)
    return raw[1:] if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _packed(raw: bytes) -> bytes:
    ids = np.frombuffer(raw, "<u4")
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\0" + raw)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the store: ``path/documents`` and ``path/manifest`` (Parquet).

    ``documents`` is in ascending id order over its shards: a row has the
    document's recipe (digests and ends of its chunks), the Merkle root over
    them, the chunks that this document is the first to hold, and for every other
    chunk the row that holds it. ``manifest`` has a row per shard: its documents,
    its ids, the ids before it, and the root over its documents' roots.

    Null and empty texts are the end id alone. Rows that repeat an id keep their
    own places; null ids come first. A text may be of any length. An empty table
    gives empty files. Chunks are found by digest, a 128-bit BLAKE2b.
    """
    spark = docs.sparkSession
    _short_reads(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.monotonically_increasing_id().alias("r"), F.col(f"`{text_col}`").alias("t"))
    made = _stage(_encoded(rows, tokenizer, end_id), "encoded")
    refs = made.select("d", "r", F.posexplode("digests").alias("i", "g"))
    shared = refs.groupBy("g").agg(F.min(F.struct(F.col("d").isNotNull().alias("x"), "d", "r", "i")).alias("o"), F.count("*").alias("m")).where("m > 1")
    shared = _stage(shared.select("g", F.col("o.d").alias("od"), F.col("o.r").alias("or"), F.col("o.i").alias("oi")), "shared")
    taken = refs.join(shared, "g").where("r <> or OR i <> oi").select("d", "r", F.lit(1).alias("kind"), "i", F.col("or").alias("s"), F.col("oi").alias("j"))
    given = shared.select(F.col("od").alias("d"), F.col("or").alias("r"), F.lit(0).alias("kind"), F.col("oi").alias("i"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("int").alias("j"))
    notes = given.unionByName(taken)
    for c, t in (("n", "long"), ("digests", "array<binary>"), ("ends", "array<int>"), ("z", "binary")):
        notes = notes.withColumn(c, F.lit(None).cast(t))
    whole = made.select("d", "r", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("int").alias("j"), "n", "digests", "ends", "z")
    # what is known of a document's chunks stands before it, in one range partitioning
    ordered = whole.unionByName(notes).repartitionByRange(partitions(spark), "d", "r").sortWithinPartitions("d", "r", "kind", "i").withColumn("shard", F.spark_partition_id())

    def run(batches):
        forget_words()
        pos, rank, gives, takes = 0, 0, [], []
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["kind"] == 0:
                    gives.append(x["i"])
                elif x["kind"] == 1:
                    takes.append({"i": x["i"], "r": x["s"], "j": x["j"]})
                else:
                    ends, foreign = x["ends"], {t["i"] for t in takes}
                    own = [i for i in range(len(ends)) if i not in foreign]
                    if foreign:
                        raw, starts = _raw(x["z"]), [0, *ends]
                        z = _packed(b"".join(raw[4 * starts[i] : 4 * ends[i]] for i in own))
                    else:
                        z = x["z"]
                    out.append((x["d"], x["r"], x["shard"], rank // BLOCK, pos, x["n"], merkle(list(x["digests"])), x["digests"], ends, z, own, gives, takes))
                    pos, rank, gives, takes = pos + x["n"], rank + 1, [], []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SCHEMA)], names=_SCHEMA.names)

    ordered.mapInArrow(run, _STORED).write.options(**_FILES).mode("overwrite").parquet(f"{path}/documents")
    _drop(made)
    # one row per shard
    held = _shards(spark.read.schema(_STORED).parquet(f"{path}/documents"))
    manifest = held.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))
    manifest.select("shard", "n_docs", "n_tokens", "start", "root").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _shards(store: DataFrame) -> DataFrame:
    """(shard, n_docs, n_tokens, root) as the documents' rows have them: a hash over the roots of each block, then one over the shard's blocks."""

    def over(order: str) -> Column:
        roots = F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda x: F.hex(x["root"]))
        return F.unhex(F.sha2(F.array_join(roots, ""), 256)).alias("root")

    blocks = store.groupBy("shard", "block").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), over("pos"))
    return blocks.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), over("block"))


_SCHEMA = pa.schema([("d", pa.int64()), ("r", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("pos", pa.int64()), ("n", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("own", pa.binary()), ("own_index", pa.list_(pa.int32())), ("given", pa.list_(pa.int32())), ("taken", pa.list_(pa.struct([("i", pa.int32()), ("r", pa.int64()), ("j", pa.int32())])))])


def _drop(staged: DataFrame) -> None:
    spark = staged.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rebuild every document from the files and verify it: (doc_id, start, n_tokens, ids_crc32[, ids]).

    The manifest's counts and shard roots are checked at once, by the documents' roots; when the rows are
    computed, every chunk's digest and every document's Merkle root is. A difference raises. ``ids``: little-endian uint32 bytes.
    """
    _short_reads(spark)
    store = spark.read.schema(_STORED).parquet(f"{path}/documents")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    if broken := [r.shard for r in verify_shards(spark, path).limit(9).collect()]:
        raise ValueError(f"shards that differ from the manifest: {broken}")

    def give(batches):
        forget_words()
        for batch in batches:
            out = []
            for r, ends, own, index, given in zip(*(batch.column(c).to_pylist() for c in range(5))):
                raw, starts, at = _raw(own), [0, *ends], 0
                wanted = set(given)
                for i in index:
                    size = 4 * (ends[i] - starts[i])
                    if i in wanted:
                        out.append((r, i, _packed(raw[at : at + size])))
                    at += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=pa.schema([("s", pa.int64()), ("j", pa.int32()), ("chunk", pa.binary())]))

    chunks = store.where(F.size("given") > 0).select("r", "ends", "own", "own_index", "given").mapInArrow(give, "s long, j int, chunk binary")
    wanted = store.where(F.size("taken") > 0).select("r", F.explode("taken").alias("t")).select("r", F.col("t.i").alias("i"), F.col("t.r").alias("s"), F.col("t.j").alias("j"))
    got = wanted.join(chunks, ["s", "j"]).select("r", F.lit(0).alias("kind"), "i", "chunk")
    for c, t in (("d", "long"), ("shard", "int"), ("pos", "long"), ("n", "long"), ("root", "binary"), ("digests", "array<binary>"), ("ends", "array<int>"), ("own_index", "array<int>")):
        got = got.withColumn(c, F.lit(None).cast(t))
    fields = ["r", "kind", "i", "chunk", "d", "shard", "pos", "n", "root", "digests", "ends", "own_index"]
    rows = store.select("r", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("i"), F.col("own").alias("chunk"), "d", "shard", "pos", "n", "root", "digests", "ends", "own_index", (F.size("taken") == 0).alias("alone"))
    plain, mixed = rows.where("alone").select(*fields), rows.where("NOT alone").select(*fields)
    mixed = mixed.unionByName(got.select(*fields)).repartition("r").sortWithinPartitions("r", "kind", "i")

    def build(batches):
        forget_words()
        held: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["kind"] == 0:
                    held[x["i"]] = _raw(x["chunk"])
                    continue
                raw, ends, at = _raw(x["chunk"]), x["ends"], 0
                starts = [0, *ends]
                for i in x["own_index"]:
                    size = 4 * (ends[i] - starts[i])
                    held[i] = raw[at : at + size]
                    at += size
                parts = [held.get(i, b"") for i in range(len(ends))]
                if [digest(p) for p in parts] != list(x["digests"]) or merkle(list(x["digests"])) != x["root"]:
                    raise ValueError(f"document {x['d']} doesn't match its recipe")
                whole = b"".join(parts)
                out.append((x["d"], x["shard"], x["pos"], len(whole) // 4, zlib.crc32(whole), x["root"], whole if with_ids else None))
                held = {}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["d", "shard", "pos", "n", "crc", "root", "ids"])

    built = "d long, shard int, pos long, n long, crc long, root binary, ids binary"
    docs = plain.mapInArrow(build, built).unionByName(mixed.mapInArrow(build, built))
    out = docs.join(manifest.select("shard", F.col("start").alias("base")), "shard").select(F.col("d").alias("doc_id"), (F.col("base") + F.col("pos")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []))
    return out


def verify_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose documents, ids or root over their documents' roots aren't the manifest's; none if the store is whole."""
    found = _shards(spark.read.schema(_STORED).parquet(f"{path}/documents")).select("shard", *[F.col(c).alias(f"found_{c}") for c in ("n_docs", "n_tokens", "root")])
    same = F.col("n_docs").eqNullSafe(F.col("found_n_docs")) & F.col("n_tokens").eqNullSafe(F.col("found_n_tokens")) & F.col("root").eqNullSafe(F.col("found_root"))
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").join(found, "shard", "full").where(~same).select("shard")
