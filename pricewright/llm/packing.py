"""Packing: length buckets by dynamic programming over the global histogram, token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stage

#: Lengths up to this are a bin each; above, a bin is 1/256 of the power of two below its lengths.
EXACT = 512


def n_words(text: Column | str) -> Column:
    """Words (runs of characters other than white space) of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def bin_edge(length: Column) -> Column:
    """The largest length of the bin of ``length``: a fixed rule, so the histogram is bounded whatever the corpus holds."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 8)).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step) * step).cast("long")


def boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted bin edges, with the least total padding.

    cost(i, j) = edge[j] * (rows in i..j) - (tokens in i..j); the second term
    sums to a constant, so each step minimises the padded size. O(buckets * bins ** 2), vectorised.
    """
    if not len(edges):
        return []
    edges = edges.astype(np.float64)
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    n = len(edges)
    best = edges * rows[1:]
    back = [np.zeros(n, int)]
    for _ in range(1, min(buckets, n)):
        # last bucket is i..j: what ends at i - 1, and edge[j] for the rows since
        cost = np.full((n, n), np.inf)
        i = np.arange(1, n)
        cost[:, 1:] = best[i - 1][None, :] + edges[:, None] * (rows[1:][:, None] - rows[i][None, :])
        cost[np.triu_indices(n, 1)] = np.inf
        cost[:, 0] = edges * rows[1:]
        at = cost.argmin(1)
        best, before = cost[np.arange(n), at], best
        back.append(at)
        if np.array_equal(best, before):
            break
    out, j = [], n - 1
    for at in reversed(back):
        out.append(int(edges[j]))
        if (j := at[j] - 1) < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Deal documents into batches of at most ``budget`` padded tokens.

    The histogram of all lengths goes to the driver: its bins follow a fixed
    rule (``bin_edge``), so it holds a few thousand rows for any corpus.
    Dynamic programming chooses the at most ``buckets`` upper bounds that
    minimise padding. In a bucket of bound L, documents in id order form batches
    of ``max(1, budget // L)`` rows; one longer than the budget stands alone.

    Positions in a bucket come from a range partitioning by (bucket, id), the
    counts of each partition and their running sums: no bucket meets in one
    task. Ties and repeated ids: every row keeps a place of its own. Null ids
    come first. Length 0 (null, empty) is packed like any other. An empty table
    gives an empty result. Returns (id, n_tokens, bucket, batch, slot, padding).
    """
    spark = docs.sparkSession
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("d"), length.cast("long").alias("n")), "lengths").withColumn("e", bin_edge(F.col("n")))
    seen = rows.groupBy("e").agg(F.count("*").alias("c")).orderBy("e").toPandas()
    bounds = boundaries(seen["e"].to_numpy(), seen["c"].to_numpy(), buckets)
    bucket = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), lambda b: b >= F.col("e")), 1)
    dealt = rows.select("d", "n", bucket.alias("b")).repartitionByRange(partitions(spark), "b", "d")
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    # the window below sees partitions x buckets rows, not documents
    held = dealt.groupBy("b", "part").agg(F.count("*").alias("c"))
    base = held.withColumn("base", F.sum("c").over(Window.partitionBy("b").orderBy("part")) - F.col("c")).drop("c")
    own = Window.partitionBy("b", "part").orderBy("d", "n")
    at = dealt.withColumn("r", F.row_number().over(own) - 1).join(base, ["b", "part"]).withColumn("r", F.col("r") + F.col("base"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("b", F.lit(1)))).cast("long")
    return at.select(
        F.col("d").alias(id_col), F.col("n").alias("n_tokens"), F.col("b").alias("bucket"),
        F.floor(F.col("r") / size).cast("long").alias("batch"), (F.col("r") % size).cast("int").alias("slot"), (F.col("b") - F.col("n")).alias("padding"),
    )
