"""N-gram Jaccard join by a token-group matrix, and the classes that its links form."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, small, stage, steps
from .components import components
from .hashing import _ROLE, Words, mix

#: Counters of shingle frequencies by hash; they order shingles, so their number has no say in the result.
COUNTERS = 1 << 20
#: Documents of a group that share a row of the matrix.
PART = 64
#: Sketch keys per document for the first grouping.
KEYS = 6
#: 64-bit words of a document's parity bitmap.
BITS = 16
_STEPS = (np.arange(2 * KEYS, dtype=np.uint64) * np.uint64((1 << 64) // (2 * KEYS))).astype(np.uint64)


def _sets(texts: list[str | None], k: int):
    for at, raws in steps(texts):
        yield at, Words(raws).shingles(k)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short) or 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per counter, summed over all documents; ``docs(d, t)``."""

    def count(batches):
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, sets in _sets(batch.column(1).to_pylist(), k):
                whole = np.concatenate(sets)
                held += np.bincount((whole >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        for i, part in enumerate(np.split(held, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(part)])], ["i", "v"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // 64, np.int64)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(zlib.decompress(v), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([squeeze(total)])], ["i", "v"])

    squeeze = lambda x: zlib.compress(x.astype("<i8").tobytes(), 1)
    # a tree: sums of a hundredth of the tasks each, then of those; 64 rows, 8 MB at most, come to the driver
    some = docs.mapInArrow(count, "i int, v binary").withColumn("j", (F.spark_partition_id() % 100).cast("int"))
    parts = some.groupBy("i", "j").applyInArrow(add, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()
    out = np.zeros(COUNTERS, np.int64)
    for row in parts:
        out[row.i * (COUNTERS // 64) : (row.i + 1) * (COUNTERS // 64)] = np.frombuffer(zlib.decompress(row.v), "<i8")
    return out


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs(d, t)`` -> (d, n, digest of the set, sketch keys, prefix, parity bitmap).

    ``prefix``: the rarest shingles, so many that any two linked sets share one of them.
    ``keys``: the hash range is cut into ``2 * KEYS`` steps; from each on, the next shingle counts, and two of them make a key.
    ``bits``: for each of ``64 * BITS`` places whether an odd number of shingles falls there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))

    def run(batches):
        count = shared.value
        for batch in batches:
            d, texts, out = batch.column(0), batch.column(1).to_pylist(), []
            for _, sets in _sets(texts, k):
                for s in sets:
                    n = len(s)
                    if not n:
                        out.append((0, 0, 0, [], [], []))
                        continue
                    h1, h2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
                    low = s[np.searchsorted(s, _STEPS) % n]
                    keys = (mix(low[::2] * _ROLE[30] + low[1::2] * _ROLE[31]) ^ np.arange(KEYS, dtype=np.uint64)).view(np.int64)
                    m = n - (percent * n + 99) // 100 + 1
                    f = count[(s >> np.uint64(44)).astype(np.int64)]
                    if m < n:
                        near = np.flatnonzero(f <= np.partition(f, m - 1)[m - 1])  # with all ties at the edge
                    else:
                        near = np.arange(n)
                    pick = near[np.lexsort((s[near], f[near]))][:m]
                    odd = np.bincount((s % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
                    out.append((n, h1, h2, keys, s[pick].view(np.int64), np.packbits(odd.astype(np.uint8)).view("<i8")))
            c = list(zip(*out))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([d, *[pa.array(c[i], pa.int64()) for i in range(3)], *[pa.array(c[i], longs) for i in range(3, 6)]], ["d", "n", "h1", "h2", "keys", "prefix", "bits"])

    return docs.mapInArrow(run, "d long, n long, h1 long, h2 long, keys array<long>, prefix array<long>, bits array<long>")


def distance(a: str, b: str) -> Column:
    """Places in which the bitmaps of two columns differ: never more than the shingles that one set has and the other hasn't."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, BITS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def matrix(marks: DataFrame, members: DataFrame) -> DataFrame:
    """(token, c, p, lo, hi, bits, r): the prefix shingles that several groups share, with each part that holds them.

    ``lo``, ``hi``: sizes of the holders of that shingle in the part. ``bits``: the
    bitmap of one member of the part, ``r``: how far the others' bitmaps are from it at most.
    """
    own = stage(marks.join(small(members), "d").select("c", "p", "d", "n", "bits"), "parts")
    centre = own.groupBy("c", "p").agg(F.min("d").alias("z"), F.count("*").alias("m"))
    alone = own.join(centre.where("m = 1").select("c", "p"), ["c", "p"]).select("c", "p", "bits", F.lit(0).cast("long").alias("r"))
    middle = own.join(centre.where("m > 1").select("c", "p", F.col("z").alias("d")), ["c", "p", "d"]).select("c", "p", F.col("bits").alias("middle"))
    several = own.join(middle, ["c", "p"]).groupBy("c", "p").agg(F.first("middle").alias("bits"), F.max(distance("bits", "middle")).cast("long").alias("r"))
    parts = stage(alone.unionByName(several), "parts")
    rows = marks.select("d", "n", "prefix").join(small(members), "d").select("c", "p", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token")).repartition("token")
    # the same columns on both sides, so that the rows are dealt once
    again = rows.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("n").alias("x"), F.min("p").alias("y")).where("a < b AND x > 0 AND y >= 0").select("token")
    held = rows.join(again.hint("shuffle_hash"), "token", "left_semi").groupBy("token", "c", "p").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return held.join(parts, ["c", "p"])


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each row of ``wanted(d, ...)``, a staged table."""
    return docs.join(small(wanted), "d")


def near_groups(reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between documents and the centre of a group of theirs: a first, linear pass.

    Documents of one sketch key are a group. Its centre is the document whose
    keys are the most common ones: the least edited copy. A document is checked
    against one centre, the most common of its groups.
    """
    keys = reps.select("d", F.explode("keys").alias("key"))
    common = keys.join(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    ranked = stage(common.join(common.groupBy("d").agg(F.sum("m").alias("s")), "d").select("key", "d", F.struct("s", (-F.col("d")).alias("nd")).alias("r")), "keys")
    lead = ranked.groupBy("key").agg(F.max("r").alias("top"))
    pairs = ranked.join(lead, "key").groupBy("d").agg((-F.max("top")["nd"]).alias("c")).where("d <> c")
    # a centre meets its documents in blocks
    pairs = stage(pairs.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(1 << 20))), "stars")
    size = pairs.groupBy("c").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    pairs = pairs.join(size, "c").withColumn("block", F.col("block") % F.col("blocks"))
    rows = stage(pairs.select("c", "block", "d").unionByName(pairs.select("c", "block", F.col("c").alias("d")).distinct()), "wanted")

    def check(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, a, b = key[0].as_py(), [], []
        centre, others = None, []
        for batch in batches:
            ids = batch.column("d").to_pylist()
            for at, sets in _sets(batch.column("t").to_pylist(), k):
                for i, s in enumerate(sets):
                    if ids[at + i] == c:
                        centre = s
                    else:
                        others.append((ids[at + i], s))
        for d, s in others:
            if centre is not None and similar(centre, s, percent):
                a.append(c)
                b.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _with_texts(rows, docs).select("c", "block", "d", "t").groupBy("c", "block").applyInArrow(check, "a long, b long")


def open_groups(found: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links across pairs of parts (c1, p1, c2, p2): a part is opened to a document only if the union bound lets it."""
    sides = found.select("c1", "p1", "c2", "p2", F.explode(F.array(F.lit(1), F.lit(2))).alias("side")).withColumn("c", F.when(F.col("side") == 1, F.col("c1")).otherwise(F.col("c2"))).withColumn("p", F.when(F.col("side") == 1, F.col("p1")).otherwise(F.col("p2")))
    rows = stage(sides.join(members, ["c", "p"]).select("c1", "p1", "c2", "p2", "side", "d"), "opened")

    def check(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side: tuple[list, list] = ([], [])
        for batch in batches:
            ids, which = batch.column("d").to_pylist(), batch.column("side").to_pylist()
            for at, sets in _sets(batch.column("t").to_pylist(), k):
                for i, s in enumerate(sets):
                    side[which[at + i] - 1].append((ids[at + i], s))
        a, b = [], []
        one, two = side
        if one and two:
            if len(one) < len(two):
                one, two = two, one
            union = np.unique(np.concatenate([s for _, s in one]))
            for d, q in two:
                at = np.searchsorted(union, q)
                if 100 * int((union[np.minimum(at, len(union) - 1)] == q).sum()) < percent * len(q):
                    continue  # no member of the part can share enough
                hit = next((e for e, s in one if similar(q, s, percent)), None)
                if hit is not None:  # the part is one class already
                    a.append(d)
                    b.append(hit)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _with_texts(rows, docs).select("c1", "p1", "c2", "p2", "side", "d", "t").groupBy("c1", "p1", "c2", "p2").applyInArrow(check, "a long, b long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose word ``k``-shingle sets link at ``percent`` of Jaccard similarity.

    Words are runs of anything but ASCII white space, A-Z in lower case. A
    document with fewer than ``k`` words has its whole sequence as the one
    shingle; without words (null, empty, blank) it has none and links with
    nothing. Returns (id, n_shingles, component_id): one row per document.

    1. Documents of equal sets are one class from the start (128-bit digest).
    2. Documents that share sketch keys are checked against the centre of their
       group; the links make up groups of similar documents, each connected.
    3. Groups are cut into parts of some ``PART`` documents. The matrix holds, for each part, the
       union of its members' prefix shingles. Shingles are ordered from rare to
       frequent by counters over the whole corpus, so common passages hardly
       reach a prefix. Parts of different groups are candidates if
       their sizes allow it and they share as many prefix shingles as linked
       sets of such sizes must: no link escapes, by the prefix filter's bound.
    4. For a candidate the union of a part's whole sets bounds what a document
       shares with any member; only where it reaches ``percent`` of the document is the part
       opened and its members compared, by whole sets. That happens in two
       rounds: each part with the one that it shares most with, then all
       candidates whose groups the first round hasn't joined.
    5. All links give the components.

    Ids must be whole numbers and not null (rows with null ids are left out);
    rows that repeat an id are one document, whose text is the first of theirs in order.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("t")).where("d IS NOT NULL")
    if docs.groupBy("d").count().where("count > 1").limit(1).count():
        docs = stage(docs.groupBy("d").agg(F.min("t").alias("t")), "texts")
    marks = stage(fingerprints(docs, k, percent), "marks")
    full = marks.where("n > 0")
    rep = full.groupBy("h1", "h2", "n").agg(F.min(F.struct("d", "keys")).alias("x")).select("h1", "h2", "n", F.col("x.d").alias("rep"), F.col("x.keys").alias("keys"))
    rep = stage(rep, "classes")
    reps = rep.select(F.col("rep").alias("d"), "keys")

    first = stage(near_groups(reps, docs, k, percent), "links")
    group = components(first)
    size = group.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    group = group.join(size, "component").select(F.col("node").alias("d"), F.col("component").alias("c"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("p"))
    members = stage(reps.select("d").join(group, "d", "left").select("d", F.coalesce("c", "d").alias("c"), F.coalesce("p", F.lit(0)).alias("p")), "groups")
    shared = stage(matrix(marks, members), "matrix")
    side = lambda i: shared.select("token", *[F.col(x).alias(f"{x}{i}") for x in ("c", "p", "lo", "hi", "bits", "r")])
    sizes = F.expr(f"c1 < c2 AND 100 * hi1 >= {percent} * lo2 AND 100 * hi2 >= {percent} * lo1")
    # of linked sets, (100 - percent) / (100 + percent) of both sizes at most are in one alone
    close = (100 + percent) * (distance("bits1", "bits2") - F.col("r1") - F.col("r2")) <= (100 - percent) * (F.col("hi1") + F.col("hi2"))
    found = side(1).join(side(2).withColumnRenamed("token", "token2"), (F.col("token") == F.col("token2")) & sizes & close)
    found = found.groupBy("c1", "p1", "c2", "p2").agg(F.count("*").alias("shared"), F.min("lo1").alias("lo1"), F.max("hi1").alias("hi1"), F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2"))
    # linked sets share so many prefix shingles, by the sizes that the shared ones' holders have
    least = F.ceil(percent * (F.col("lo1") + F.col("lo2")) / (100 + percent)) - F.ceil(percent * F.greatest("hi1", "hi2") / 100) + 1
    found = stage(found.where(F.col("shared") >= least).select("c1", "p1", "c2", "p2", "shared"), "candidates")
    # each part goes to the one that it shares most with; that joins most of what belongs together
    own = found.select(F.col("c1").alias("c"), F.col("p1").alias("p"), F.struct("shared", "c1", "p1", "c2", "p2").alias("x")).unionByName(found.select(F.col("c2").alias("c"), F.col("p2").alias("p"), F.struct("shared", "c1", "p1", "c2", "p2").alias("x")))
    best = own.groupBy("c", "p").agg(F.max("x").alias("x")).select("x.c1", "x.p1", "x.c2", "x.p2").distinct()
    second = stage(open_groups(best, members, docs, k, percent), "links")
    # all other candidates whose groups are still apart
    now = stage(members.select("d", "c").join(components(second.unionByName(first)).withColumnRenamed("node", "d"), "d").groupBy("c").agg(F.min("component").alias("to")), "joined")
    name = lambda i: now.select(F.col("c").alias(f"c{i}"), F.col("to").alias(f"to{i}"))
    rest = found.join(best, ["c1", "p1", "c2", "p2"], "left_anti").join(name(1), "c1", "left").join(name(2), "c2", "left")
    rest = stage(rest.where("coalesce(to1, c1) <> coalesce(to2, c2)").select("c1", "p1", "c2", "p2"), "rest")
    links = first.unionByName(second).unionByName(open_groups(rest, members, docs, k, percent))
    joined = components(links)
    to = rep.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    one = marks.select("d", "n", "h1", "h2").dropDuplicates(["d"])
    named = one.where("n > 0").join(to, ["h1", "h2", "n"]).select("d", "n", "component").unionByName(one.where("n = 0").select("d", "n", F.col("d").alias("component")))
    return named.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
