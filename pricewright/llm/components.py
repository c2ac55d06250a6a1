"""Connected components of staged edges, on the executors alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Edges that one task holds at once (two longs each), in any of the steps.
LOCAL = 1_000_000


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by the edges."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = labels(len(names), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(low != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[low[own]])], ["a", "b"])


def forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: runs of ``LOCAL`` edges become stars around their smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= LOCAL:
                yield _stars(np.concatenate(a), np.concatenate(b))
                a, b, n = [], [], 0
        if n:
            yield _stars(np.concatenate(a), np.concatenate(b))

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: for every node with an edge, the smallest node that it reaches.

    Each task turns its edges into stars first. What is left is counted: up to
    ``local`` edges are joined up by one task, more by large-star and small-star
    rounds of equi-joins, whose number grows with the logarithm of the longest
    path. Every round is staged in the shared folder, so a lost executor repeats
    one round at most. Edges from a node to itself and edges with nulls are left
    out; without edges the result is empty.
    """
    now = stage(forest(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    mark = _mark(now)
    if mark[0] <= local:
        now = stage(forest(now.coalesce(1)), "edges")
        return _named(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the smallest of a node's smaller neighbours; itself and the others then point to that
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stage(small.distinct(), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return both.groupBy("node").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
