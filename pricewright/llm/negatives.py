"""Hard negatives from k-means inverted lists with stored radii, visited by the bound of Cauchy and Schwarz."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import small, stage
from .vectors import usable

#: Rows that k-means is fitted on, about (those with the smallest hashes of their ids), and their bytes at most; it has so many clusters at most.
SAMPLE, SAMPLE_BYTES, CLUSTERS = 8192, 16 << 20, 1024
#: Rows of an inverted list; a cluster with more is cut into several. Rows of a block of anchors. Bytes of the lists that one task holds, about.
LIST, BLOCK, TASK_BYTES = 1024, 4096, 4 << 20

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Index:
    """Of vectors of one length: centroids, the radius of each cluster over all rows, and the rows that k-means saw."""

    centroids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    data: np.ndarray
    radius: np.ndarray


def whole(data: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * data).clip(-(2.0**62), 2.0**62).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, by the fast route if doubles hold them."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 1 << 53 else a @ b.T


def kmeans(data: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids after some rounds of Lloyd's, from evenly spread rows; an emptied one keeps its place."""
    x = data.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def bounds(q: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a row within ``radius`` of each centroid can have with each query, a little wider than rounding."""
    q = q.astype(np.float64)
    mid, reach = q @ c.T, np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
    slack = 1 + 1e-9 * (np.abs(mid) + reach)
    return mid - reach - slack, mid + reach + slack


def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by smaller id."""
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def bars(q: np.ndarray, qid: np.ndarray, ql: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: Index, k: int, same: bool) -> np.ndarray:
    """The ``k``-th score that the sample's rows alone give each query in each of its windows; what can't reach it is no result."""
    out = np.full(lo.shape, _LOW)
    for a in range(0, len(q), 512):
        s = products(q[a : a + 512], index.data)
        fits = (ql[a : a + 512, None] == index.labels[None, :]) == same
        fits &= qid[a : a + 512, None] != index.ids[None, :]
        for w in range(lo.shape[1]):
            t = np.where(fits & (s >= lo[a : a + 512, w, None]) & (s <= hi[a : a + 512, w, None]), s, _LOW)
            if t.shape[1] >= k:
                out[a : a + 512, w] = np.partition(t, t.shape[1] - k, 1)[:, -k]
    return out


def visit(q: np.ndarray, qid: np.ndarray, ql: np.ndarray, lo: np.ndarray, hi: np.ndarray, bar: np.ndarray, lists: list[tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(query, window, id, score): the ``k`` best rows of the lists in each window [lo, hi] of each query, of the query's label or of others.

    lists: (centroid, radius, ids, labels, rows). A query visits them by falling upper bound, skips those
    whose bounds lie outside all its windows, and ends at the first whose upper bound is strictly below the
    ``k``-th scores of all of them. Queries that visit a list in the same step do so in one product.
    """
    m, n_w = lo.shape
    low, high = bounds(q, np.stack([x[0] for x in lists]), np.array([x[1] for x in lists]))
    order = np.argsort(-high, 1, kind="stable")
    must = np.where(lo > hi, _HIGH, np.maximum(lo, bar))
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    live = np.arange(m)
    for step in range(len(lists)):
        at = order[live, step]
        up = high[live, at]
        going = up >= must[live].min(1)
        live, at, up = live[going], at[going], up[going]
        if not len(live):
            break
        inside = ((up[:, None] >= must[live]) & (low[live, at][:, None] <= hi[live])).any(1)
        seen, at = live[inside], at[inside]
        turn = np.argsort(at, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(at[turn]) != 0, [True]])) if len(at) else []
        for x, y in zip(edge[:-1], edge[1:]):
            rows = seen[turn[x:y]]
            _, _, ids, labels, data = lists[at[turn[x]]]
            s = products(q[rows], data)
            fits = (ql[rows, None] == labels[None, :]) == same
            fits &= qid[rows, None] != ids[None, :]
            for w in range(n_w):
                good = fits & (s >= must[rows, w, None]) & (s <= hi[rows, w, None])
                for r in np.flatnonzero(good.any(1)):
                    i, c = int(rows[r]), np.flatnonzero(good[r])
                    old_s, old_d = kept.get((i, w), (s[r, :0], ids[:0]))
                    new_s, new_d = np.concatenate([old_s, s[r, c]]), np.concatenate([old_d, ids[c]])
                    b = best_of(new_s, new_d, k)
                    kept[i, w] = new_s[b], new_d[b]
                    if len(b) == k:
                        must[i, w] = max(must[i, w], int(new_s[b[-1]]))
    for (i, w), (s, d) in kept.items():
        for score, other in zip(s.tolist(), d.tolist()):
            yield i, w, other, score


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<i8").tobytes()


def _longs(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(*shape) if shape else np.frombuffer(raw, "<i8")


def _fit(v: DataFrame, scale: int) -> dict[int, Index]:
    """k-means of the vectors of each length, on a sample that is bounded in all (a row per length comes to the driver before)."""
    sizes = v.groupBy("dim").agg(F.count("*").alias("n")).collect()
    total = sum(s.n for s in sizes)
    out = {}
    for s in sizes:
        want = max(1, min(SAMPLE * s.n // total, SAMPLE_BYTES // (8 * s.dim)))
        picked = v.where((F.col("dim") == s.dim) & (F.pmod(F.xxhash64("d"), F.lit(1 << 31)) < F.lit(min(1.0, want / s.n) * (1 << 31)))).select("d", "l", "v").toArrow()
        data = whole(picked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(picked.num_rows, s.dim), scale)
        k = min(CLUSTERS, max(1, s.n // LIST), max(1, picked.num_rows // 8))
        centroids = kmeans(data, k) if picked.num_rows else np.zeros((1, s.dim))
        out[s.dim] = Index(centroids, picked.column("d").to_numpy(), picked.column("l").to_numpy(), data, np.zeros(len(centroids)))
    return out


def _assigned(v: DataFrame, index: dict[int, Index], scale: int) -> DataFrame:
    """(d, l, q, dim, c, x): each row's nearest centroid, and its components as whole numbers."""
    centroids = {dim: i.centroids for dim, i in index.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = whole(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), scale)
                c = nearest(x.astype(np.float64), centroids[int(dim)])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in ("d", "l", "q", "dim")], pa.array(c.astype(np.int32)), pa.array([_raw(r) for r in x], pa.binary())], ["d", "l", "q", "dim", "c", "x"])

    return v.mapInArrow(assign, "d long, l long, q boolean, dim int, c int, x binary")


def _blocks(rows: DataFrame, n: int, extra: str | None = None, center: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(dim, c, piece, ids, labels, data, w, radius): runs of ``n`` rows or so, in id order; ``w``: the rows' ``extra`` bytes.

    With centers a block holds rows of one cluster; without, clusters that follow each other share blocks (``c``: the first of them).
    """
    spark = rows.sparkSession
    sizes = sorted((r.dim, r.c, r.n) for r in rows.groupBy("dim", "c").agg(F.count("*").alias("n")).collect())  # a row per centroid
    deal, last = [], None
    for dim, c, size in sizes:
        if center is None and last and last[0] == dim and last[2] + size <= n:
            last = (dim, last[1], last[2] + size)
        else:
            last = (dim, c, size)
        deal.append((dim, c, last[1], -(-size // n)))
    deal = F.broadcast(spark.createDataFrame(deal, "dim int, c int, into int, pieces int"))
    dealt = rows.join(deal, ["dim", "c"]).withColumn("piece", F.pmod(F.xxhash64("d"), "pieces").cast("int")).drop("c").withColumnRenamed("into", "c")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("d")
        dim, c, piece = (k.as_py() for k in key)
        x = np.stack([_longs(r) for r in t.column("x").to_pylist()])
        r = float(np.sqrt(((x - center[dim][c]) ** 2).sum(1).max())) if center else 0.0
        w = b"".join(t.column(extra).to_pylist()) if extra else b""
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([c], pa.int32()), pa.array([piece], pa.int32()), *[pa.array([_raw(a)], pa.binary()) for a in (t.column("d").to_numpy(), t.column("l").to_numpy(), x)], pa.array([w], pa.binary()), pa.array([r])], ["dim", "c", "piece", "ids", "labels", "data", "w", "radius"])

    cols = ["dim", "c", "piece", "d", "l", "x", *([extra] if extra else [])]
    return dealt.select(*cols).groupBy("dim", "c", "piece").applyInArrow(pack, "dim int, c int, piece int, ids binary, labels binary, data binary, w binary, radius double")


def _searched(asked: DataFrame, lists: DataFrame, index: dict[int, Index], groups: dict[int, int], k: int, same: bool) -> DataFrame:
    """(q, w, d, score) of blocks of anchors against all lists; ``w`` of a block holds pairs (lo, hi) per anchor, the same number for each."""

    def windows(r: dict) -> tuple[np.ndarray, ...]:
        ids, labels = _longs(r["ids"]), _longs(r["labels"])
        w = _longs(r["w"], len(ids), -1, 2)
        return _longs(r["data"], len(ids), r["dim"]), ids, labels, w[:, :, 0], w[:, :, 1]

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bar, needs = [], []
            for r in b.to_pylist():
                q, qid, ql, lo, hi = windows(r)
                at = index[r["dim"]]
                bar.append(bars(q, qid, ql, lo, hi, at, k, same))
                must = np.where(lo > hi, _HIGH, np.maximum(lo, bar[-1]))
                low, high = bounds(q, at.centroids, at.radius)
                some = np.zeros(len(at.centroids), bool)
                for w in range(lo.shape[1]):
                    some |= ((high >= must[:, w, None]) & (low <= hi[:, w, None])).any(0)
                needs.append(np.flatnonzero(some).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("dim", "c", "piece", "ids", "labels", "data", "w")], pa.array([_raw(x) for x in bar], pa.binary()), pa.array(needs, pa.list_(pa.int32()))], ["dim", "ac", "ap", "ids", "labels", "data", "w", "bar", "needs"])

    asked = stage(asked.mapInArrow(need, "dim int, ac int, ap int, ids binary, labels binary, data binary, w binary, bar binary, needs array<int>"), "asked")
    n_groups = F.lit(1)
    for dim, n in groups.items():
        n_groups = F.when(F.col("dim") == dim, n).otherwise(n_groups)
    pairs = small(stage(asked.select("dim", "ac", "ap", F.explode("needs").alias("c")), "needs"))
    no = F.lit(None).cast("binary")
    to = lists.join(pairs, ["dim", "c"]).select("dim", "ac", "ap", F.pmod(F.xxhash64("c", "piece"), n_groups).cast("int").alias("g"), F.lit(0).alias("side"), "c", "ids", "labels", "data", no.alias("w"), no.alias("bar"), "radius")
    each = asked.select("dim", "ac", "ap", F.explode(F.sequence(F.lit(0), n_groups - 1)).alias("g"), F.lit(1).alias("side"), F.lit(0).alias("c"), "ids", "labels", "data", "w", "bar", F.lit(0.0).alias("radius"))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = key[0].as_py()
        ask, lists = None, []
        for b in batches:
            for r in b.to_pylist():
                r["dim"] = dim
                if r["side"]:
                    ask = r
                else:
                    ids = _longs(r["ids"])
                    lists.append((index[dim].centroids[r["c"]], r["radius"], ids, _longs(r["labels"]), _longs(r["data"], len(ids), dim)))
        if ask and lists:
            q, qid, ql, lo, hi = windows(ask)
            found = list(visit(q, qid, ql, lo, hi, _longs(ask["bar"], *lo.shape), lists, k, same))
            if found:
                i, w, d, s = (np.array(c, np.int64) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(w.astype(np.int32)), pa.array(d), pa.array(s)], ["q", "w", "d", "score"])

    return to.unionByName(each).groupBy("dim", "ac", "ap", "g").applyInArrow(meet, "q long, w int, d long, score long")


def mine(rows: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); scores are inner products, whole and exact while 64 bits hold them.
    An anchor's positives are its ``positives`` best other rows of its label. A positive's negatives are
    the ``negatives`` best rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Equal scores go by smaller id; fewer rows give fewer results.

    1. k-means is fitted on a sample of ``SAMPLE`` rows or so (chosen by hash). Every row is put into the inverted
       list of its nearest centroid; a cluster of more than ``LIST`` rows, such as many copies of one vector, is
       several lists. Each list stores its radius.
    2. Anchors lie in blocks of their clusters. The sample's rows, which are rows of the table, give each anchor
       a first ``k``-th score. With it and the clusters' radii over all rows, a block asks for those clusters alone
       that can hold a result for one of its anchors.
    3. A task holds a block and some of the lists it asked for; ``visit`` does the search. Tasks keep the best rows
       of each anchor, windows over those choose the result. Positives are found first; their scores make
       the windows in which negatives are searched in the same way.
    All bounds are safe ones: results equal those of comparing everything.

    Rows with a null id, label or vector, empty vectors and such with null or non-finite components take no part; vectors of
    different lengths don't meet. Repeated ids are one row, the one that comes first by vector, then label. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.select(label).schema[0].dataType
    code = label.cast("long") if isinstance(kind, IntegralType) else F.when(label.isNotNull(), F.xxhash64(label))
    v = rows.select(F.col(f"`{id_col}`").cast("long").alias("d"), code.alias("l"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    v = v.where(F.col("d").isNotNull() & F.col("l").isNotNull() & usable(F.col("v"))).groupBy("d").agg(F.min(F.struct("v", "l", "q")).alias("x"))
    v = stage(v.select("d", "x.l", "x.q", "x.v", F.size("x.v").alias("dim")), "vectors")
    index = _fit(v, scale)
    if not index:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = stage(_assigned(v, index, scale), "assigned")
    lists = stage(_blocks(held, LIST, center={dim: i.centroids for dim, i in index.items()}), "lists")
    groups = {}
    for r in lists.groupBy("dim", "c").agg(F.max("radius").alias("r"), F.sum(F.octet_length("data")).alias("bytes")).collect():  # a row per centroid
        index[r.dim].radius[r.c] = r.r
        groups[r.dim] = groups.get(r.dim, 0) + r.bytes
    groups = {dim: -(-size // TASK_BYTES) for dim, size in groups.items()}

    anchors = held.where("q")
    everything = F.lit(np.array([_LOW, _HIGH], "<i8").tobytes())
    found = _searched(_blocks(anchors.withColumn("win", everything), BLOCK, "win"), lists, index, groups, positives, True)
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "d"))
    good = stage(found.withColumn("r", first).where(F.col("r") <= positives).select("q", (F.col("r") - 1).alias("w"), F.col("d").alias("p"), F.col("score").alias("ps")), "positives")

    # windows of whole numbers; an anchor with fewer positives has empty ones in their place
    lo, hi = F.ceil(F.col("ps") * F.lit(low).cast("decimal(5,0)") / 100).cast("long"), F.floor(F.col("ps") * F.lit(high).cast("decimal(5,0)") / 100).cast("long")
    wins = good.groupBy(F.col("q").alias("d")).agg(F.collect_list(F.struct("w", lo.alias("lo"), hi.alias("hi"))).alias("wins"))

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("wins").to_pylist():
                w = np.tile(np.array([[_HIGH, _LOW]]), (positives, 1))
                for x in row:
                    w[x["w"]] = x["lo"], x["hi"]
                out.append(_raw(w))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("d", "l", "dim", "c", "x")], pa.array(out, pa.binary())], ["d", "l", "dim", "c", "x", "win"])

    bound = anchors.select("d", "l", "dim", "c", "x").join(wins, "d").mapInArrow(bind, "d long, l long, dim int, c int, x binary, win binary")
    found = _searched(_blocks(bound, BLOCK, "win"), lists, index, groups, negatives, False)
    first = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.col("score").desc(), "d"))
    best = found.withColumn("rank", first).where(F.col("rank") <= negatives)
    return best.join(good, ["q", "w"]).select(F.col("q").alias("anchor_id"), F.col("p").alias("positive_id"), "rank", F.col("d").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))
