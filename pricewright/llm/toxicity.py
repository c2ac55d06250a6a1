"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, steps
from .hashing import Words

#: Features are counted in so many buckets, whatever the vocabulary.
BUCKETS = 1 << 20
#: Lengths in bytes of the word beginnings that count as features beside whole words.
PREFIXES = range(3, 8)
#: Bins of a quarter each for the token scores of clean texts, around 0.
BINS = 80
#: Margins that are looked at, in sixteenths; the mean score of clean tokens that the least of them has to reach.
STEPS, MEAN = 128, -0.09


@dataclass
class Model:
    """``weight[b]``: the score of bucket b; ``margin``: see ``token_scores``; ``lam`` and ``k``: Karlin and Altschul's parameters; ``a``, ``b``: log-odds of the aggregate."""

    weight: np.ndarray
    margin: float = 0.0
    lam: float = 1.0
    k: float = 0.1
    a: float = 1.0
    b: float = -2.0


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) arrays: the words themselves, then their beginnings."""
    mask = np.uint64(BUCKETS - 1)
    whole = [((words.hash & mask).astype(np.int64), np.arange(len(words.hash)))]
    return whole + [((h & mask).astype(np.int64), w) for h, w in words.prefixes(PREFIXES)]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float = 0.05, z: float = 2.0) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior, drawn towards 0 by ``z`` standard errors.

    toxic, clean: training documents of either class that hold the feature. The
    prior of a feature is its share of all documents, ``prior`` of them strong.
    """
    both = (toxic + clean + 0.5) / (n_toxic + n_clean + 1)
    strength = max(20.0, prior * (n_toxic + n_clean))
    a = strength * both
    up, down = toxic + a, clean + a
    delta = np.log(up / np.maximum(n_toxic + strength - up, 0.5)) - np.log(down / np.maximum(n_clean + strength - down, 0.5))
    sure = z * np.sqrt(1 / up + 1 / down)
    return np.where(delta > 0, np.maximum(delta - sure, 0), np.minimum(delta + sure, 0)).astype(np.float32)


def evidence(words: Words, weight: np.ndarray, drift: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """For each token the largest weight of its features, and its word's reason for clean, less ``drift``."""
    best = low = np.zeros(len(words.hash), np.float32)
    for i, (bucket, which) in enumerate(features(words)):
        got = weight[bucket]
        if i == 0:
            low = np.clip(got, -1, 0) - np.float32(drift)
        best[which] = np.maximum(best[which], got)
    return best, low


def token_scores(words: Words, weight: np.ndarray, margin: float) -> np.ndarray:
    """A token scores by how much the largest weight of its features is above ``margin``, else its reason for clean.

    The margin keeps the mean score of clean text below 0, however sure a large
    corpus makes small differences; without that no segment would be local.
    """
    best, low = evidence(words, weight)
    return np.where(best > margin, best - np.float32(margin), low)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, by Ruzzo and Tompa's scan over runs of one sign."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in up.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
        held.append((start, end, left, right))
    return [(s, e, r - lo) for s, e, lo, r in held]


def aggregate(scores: list[float], n: int, model: Model) -> float:
    """Sum of the bits by which segments beat what chance gives a text of ``n`` tokens (Karlin-Altschul E-values)."""
    least = math.log(max(model.k * max(n, 1), 1.0))
    return sum(max(0.0, model.lam * s - least) for s in scores)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 40_000) -> Model:
    """Learn from the labelled documents; at most ``max_rows`` of them, by hash of the id.

    Counts of features per class come from the executors as sums by bucket.
    The scores that fit the calibration leave out each text's own count, so a
    text doesn't vouch for itself. Rows without a text count as empty, rows
    without a 0/1 label or an id are left out. Without labels of both classes
    every text scores the share of toxic labels (0.5 at most, below it if there are none).
    """
    spark = docs.sparkSession
    short_batches(spark)
    labels = labels.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{label_col}`").cast("int").alias("y")).where("d IS NOT NULL AND y IN (0, 1)")
    sample = labels.groupBy("d").agg(F.max("y").alias("y")).orderBy(F.xxhash64("d"), "d").limit(max_rows)
    train = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(sample), "d").select("y", "t")

    def count(batches):
        held = np.zeros((3, BUCKETS + 1), np.int32)
        for batch in batches:
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, raws in steps(texts):
                words = Words(raws, letters=True)
                fs = features(words)
                for i in range(len(raws)):
                    lo, hi = words.first[i], words.first[i + 1]
                    own = [b[np.searchsorted(w, lo) : np.searchsorted(w, hi)] for b, w in fs]
                    held[ys[at + i], np.unique(np.concatenate(own))] += 1
                    held[ys[at + i], BUCKETS] += 1
        seen = np.flatnonzero(held[:2].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(held[0, seen]), pa.array(held[1, seen])], ["b", "c0", "c1"])

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype("<i4").tobytes()]) for i in range(3)], ["b", "c0", "c1"])

    sums = train.mapInArrow(count, "b int, c0 int, c1 int").groupBy("b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counts = np.zeros((2, BUCKETS + 1), np.float32)
    # a dozen bytes per bucket at most, as blocks of bytes
    for row in sums.mapInArrow(pack, "b binary, c0 binary, c1 binary").collect():
        at = np.frombuffer(row.b, "<i4")
        counts[0, at], counts[1, at] = np.frombuffer(row.c0, "<i4"), np.frombuffer(row.c1, "<i4")
    n0, n1 = counts[:, BUCKETS].tolist()
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 0.01), 0.5)
        return Model(np.zeros(BUCKETS, np.float32), a=0.0, b=math.log(share / (1 - share)))
    c0, c1 = counts[0, :BUCKETS], counts[1, :BUCKETS]
    weight = log_odds(c1, c0, n1, n0)
    own = spark.sparkContext.broadcast((log_odds(c1, np.maximum(c0 - 1, 0), n1, n0 - 1), log_odds(np.maximum(c1 - 1, 0), c0, n1 - 1, n0)))

    def spread(batches):
        held = np.zeros((3, STEPS + 1))
        for batch in batches:
            for _, raws in steps(batch.column(1).to_pylist()):
                best, low = evidence(Words(raws, letters=True), own.value[0])
                at = np.minimum(np.ceil(best * 16).astype(int), STEPS)
                held += [np.bincount(at, x, STEPS + 1) for x in (np.ones(len(at)), best, low)]
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()])], ["x"])

    clean = train.where("y = 0").mapInArrow(spread, "x binary").collect()  # 3 KB a task
    margin = least_margin(*np.sum([np.frombuffer(row.x).reshape(3, STEPS + 1) for row in clean], axis=0))

    def left_out(batches):
        for batch in batches:
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for at, raws in steps(texts):
                words = Words(raws, letters=True)
                both = [token_scores(words, w, margin) for w in own.value]
                for i in range(len(raws)):
                    y = ys[at + i]
                    s = both[y][words.first[i] : words.first[i + 1]]
                    bins = np.bincount(np.clip(np.floor(s * 4) + BINS // 2, 0, BINS - 1).astype(int), minlength=BINS) if y == 0 else []
                    out.append((y, len(s), [x[2] for x in segments(s)], bins))
            y, n, segs, bins = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((np.array(y, np.int8), np.array(n), segs, sum(np.asarray(b, np.int64) for b in bins if len(b))))])], ["x"])

    # the scores of max_rows texts at most, a block of bytes per batch
    blocks = [pickle.loads(row.x) for row in train.mapInArrow(left_out, "x binary").collect()]
    own.unpersist()
    y, n = np.concatenate([x[0] for x in blocks]), np.concatenate([x[1] for x in blocks])
    segs = [s for x in blocks for s in x[2]]
    model = Model(weight, margin)
    model.lam, model.k = extreme_values(np.zeros(BINS, np.int64) + sum(x[3] for x in blocks), [s for s, c in zip(segs, y) if c == 0], int(n[y == 0].sum()))
    model.a, model.b = logistic(np.array([aggregate(s, k, model) for s, k in zip(segs, n)]), y)
    return model


def least_margin(count: np.ndarray, best: np.ndarray, low: np.ndarray) -> float:
    """The smallest margin, in sixteenths, at which the mean score of clean tokens is ``MEAN`` at most.

    The tokens lie in bins by their ``best`` evidence: without any, then up to 1/16, 2/16 and so on. The arrays
    hold how many they are, and the sums of ``best`` and ``low``.
    """
    above = lambda x: np.cumsum(x[::-1])[::-1][1:]
    total = above(best) - np.arange(STEPS) / 16 * above(count) + low.sum() - above(low)
    fits = np.flatnonzero(total <= MEAN * count.sum())
    return float(fits[0] / 16) if len(fits) else STEPS / 16


def extreme_values(bins: np.ndarray, clean: list[list[float]], n_tokens: int) -> tuple[float, float]:
    """lambda: where the mean of exp(lambda * score) over clean tokens is 1; K from the clean texts' segments above the median."""
    value = (np.arange(BINS) - BINS // 2 + 0.5) / 4
    value[BINS // 2 - 1] = -0.05  # most tokens lie just below 0
    p = bins / max(bins.sum(), 1)
    if not p[value > 0].any() or (p * value).sum() >= 0:
        return 1.0, 0.05
    lo, hi = 1e-3, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * value)).sum() < 1 else (lo, mid)
    lam = min(max(lo, 0.2), 3.0)
    all_s = np.sort(np.array([x for s in clean for x in s]))
    if not len(all_s):
        return lam, 0.05
    x = all_s[len(all_s) // 2]
    k = ((all_s >= x).sum() + 0.5) / max(n_tokens, 1) * math.exp(lam * x)
    return lam, float(min(max(k, 1e-4), 1.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept of P(toxic | aggregate), by Newton's method on log(1 + x), held in by a small ridge."""
    z = np.stack([np.log1p(x), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: (id, score, predicted, passages).

    ``passages``: the significant segments, as character offsets with their
    scores. Null and empty texts score as one without any evidence. Every row
    gives one row, repeated ids too; other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, got = batch.column(1).to_pylist(), []
            for _, raws in steps(texts):
                words = Words(raws, letters=True)
                s = token_scores(words, m.weight, m.margin)
                for i, raw in enumerate(raws):
                    a, b = words.first[i], words.first[i + 1]
                    found = segments(s[a:b])
                    x = m.a * math.log1p(aggregate([f[2] for f in found], b - a, m)) + m.b
                    least = math.log(max(m.k * max(b - a, 1), 1.0))
                    spans = []
                    for u, v, w in found:
                        if m.lam * w > least:
                            lo = int(words.start[a + u] - words.at[i])
                            hi = int(words.start[a + v - 1] + words.length[a + v - 1] - words.at[i])
                            lo_c = len(raw[:lo].decode("utf-8", "ignore"))
                            spans.append({"start": lo_c, "end": lo_c + len(raw[lo:hi].decode("utf-8", "ignore")), "score": float(w)})
                    got.append((1 / (1 + math.exp(-min(max(x, -30), 30))), spans))
            p = np.array([g[0] for g in got])
            spans = pa.array([g[1] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), spans], [id_col, "score", "predicted", "passages"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
