"""Exact top-k by no-random-access aggregation over sorted lists of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .vectors import BLOCK_BYTES, packed, unpacked, vectors_of

#: Bytes of a block of queries; candidates that a query may have left when their scores are summed up.
QUERY_BYTES, FEW = 1 << 19, 64


def search(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
    """(query, id, score, depth) of each query's ``k`` best rows of ``x`` but its own; ties go to smaller ids. ``xid`` ascends.

    There are two lists per component, descending for positive and ascending for
    negative query components, read in steps: a half, then each time half of what is left. What
    hasn't been seen in a list lies between its last value read and its far end, and all
    that is unseen of a row is no longer than its length allows (Cauchy and Schwarz): that bounds
    every score from both sides. A query is settled when at most ``FEW`` rows have an upper bound that
    reaches its ``k``-th lower bound; then the scores of those rows are summed up.
    ``depth``: the share of the lists read by then.
    """
    n, top = len(x), int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    up, down, cells = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind), x.astype(kind)
    lists = np.sort(x, 0)
    low, high = lists[0], lists[-1]
    own = qid[:, None] == xid[None, :]
    live = np.arange(len(q))
    worst = np.finfo(kind).min if kind != np.int64 else np.iinfo(kind).min
    left = n
    while left > n // 32 and n > max(4 * k, FEW) and len(live):
        left //= 2
        read = n - left
        depth, last_top, last_low = read / n, lists[left], lists[read - 1]
        seen_top, seen_low = x >= last_top, x <= last_low
        a, b = up[live], down[live]
        upper = a @ np.maximum(x, last_top).T.astype(kind) + b @ np.minimum(x, last_low).T.astype(kind)
        lower = a @ np.where(seen_top, x, low).T.astype(kind) + b @ np.where(seen_low, x, high).T.astype(kind)
        if kind != np.int64:
            part = a @ (cells * seen_top).T + b @ (cells * seen_low).T
            square, plus = cells * cells, (q[live] >= 0).astype(kind)
            rest_q = (a * a) @ (~seen_top).T.astype(kind) + (b * b) @ (~seen_low).T.astype(kind)
            rest_x = square.sum(1) - plus @ (square * seen_top).T - (1 - plus) @ (square * seen_low).T
            room = np.sqrt(np.maximum(rest_q, 0) * np.maximum(rest_x, 0)) * kind(1.001) + 1
            upper, lower = np.minimum(upper, part + room), np.maximum(lower, part - room)
        lower[own[live]], upper[own[live]] = worst, worst
        bar = -np.partition(-lower, k - 1, 1)[:, k - 1] if kind != np.int64 else np.sort(lower, 1)[:, -k]
        open_ = upper >= bar[:, None]
        done = open_.sum(1) <= max(4 * k, FEW)
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(open_[i] & ~own[live[i]])
            score = (x[rows].astype(np.int64) @ q[live[i]].astype(np.int64)) if kind == np.int64 else (x[rows].astype(np.float64) @ q[live[i]].astype(np.float64))
            for r in np.lexsort((rows, -score))[:k]:
                yield int(live[i]), int(xid[rows[r]]), int(score[r]), depth
        live = live[~done]
    if len(live):
        score = (up + down)[live] @ cells.T
        yield from _best(score, own[live], live, xid, k, worst)


def _best(score: np.ndarray, own: np.ndarray, live: np.ndarray, xid: np.ndarray, k: int, worst) -> Iterator[tuple[int, int, int, float]]:
    score[own] = worst
    n = score.shape[1]
    for i, row in enumerate(score):
        bar = np.partition(row, n - k)[n - k] if n > k else worst
        rows = np.flatnonzero((row >= bar) & ~own[i])
        for r in rows[np.lexsort((rows, -row[rows]))[:k]]:
            yield int(live[i]), int(xid[r]), int(row[r]), 1.0


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score, depth): each query's ``k`` best inner products with all other rows, components as floor(scale * x).

    ``is_query`` is a condition on the id column. Candidates lie in blocks of
    bounded size, queries too; a task holds a block of either and keeps ``k``
    rows per query, of which a window keeps the ``k`` best in the end. Ties go
    to the smaller id; fewer than ``k`` candidates give fewer rows.

    Null and empty vectors and such with null or non-finite components take no
    part, nor do rows without an id; vectors of different lengths don't meet.
    Repeated ids are one vector, the one that comes first by value. Scores are whole
    64-bit numbers, exact while they fit.
    """
    spark = rows.sparkSession
    v = vectors_of(rows, id_col, vec_col).where("d IS NOT NULL").groupBy("d").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    v = stage(v.withColumn("q", F.coalesce(is_query, F.lit(False))) if id_col == "d" else v.withColumnRenamed("d", id_col).withColumn("q", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "d"), "vectors")
    sizes = v.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq")).collect()  # a row per length
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long, depth double")
    base, plan = 0, []
    for s in sorted(sizes, key=lambda s: s.dim):
        parts, qparts = max(1, -(-s.n * s.dim * 8 // (2 * BLOCK_BYTES))), max(1, -(-s.nq * s.dim * 4 // QUERY_BYTES))
        plan.append((s.dim, base, parts, qparts))
        base += parts
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, first long, parts long, qparts long"))
    dealt = v.join(plan, "dim").withColumn("h", F.xxhash64("d"))
    blocks = packed(dealt.select((F.col("first") + F.pmod("h", "parts")).alias("block"), "d", "v", "dim"), ["block"])
    asked = packed(dealt.where("q").select((F.col("first") * F.lit(1 << 20) + F.pmod("h", "qparts")).alias("block"), "d", "v", "dim"), ["block"])
    blocks, asked = stage(blocks, "blocks"), stage(asked, "asked")
    each = blocks.join(plan, "dim").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts") - 1)).alias("part"), (F.col("first") * F.lit(1 << 20)).alias("f"), F.lit(0).alias("side"), "dim", "ids", "m", "data")
    each = each.withColumn("ask", F.col("f") + F.col("part")).drop("part", "f")
    to = asked.join(plan, "dim").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"), F.lit(1).alias("side"), "dim", "ids", "m", "data", F.col("block").alias("ask"))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {}
        for b in batches:
            for r in b.select(["side", "dim", "ids", "m", "data"]).to_pylist():
                ids, _, data = unpacked(r["dim"], r["ids"], r["m"], r["data"])
                got[r["side"]] = ids, np.floor(scale * data).clip(-(2.0**62), 2.0**62).astype(np.int64)
        if len(got) == 2:
            (xid, x), (qid, q) = got[0], got[1]
            out = [(int(qid[i]), d, s, depth) for i, d, s, depth in search(q, x, qid, xid, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "d", "score", "depth"])

    found = each.unionByName(to).groupBy("block", "ask").applyInArrow(meet, "query_id long, d long, score long, depth double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "d"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("d").alias(id_col), "score", "depth")
