"""Embedding near-dedup by dual traversal of cover trees: exact pairs above a cosine threshold."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components, labels
from .vectors import BLOCK_BYTES, packed, unpacked, vectors_of

#: Radii of the nested levels; chords of the unit sphere reach 2.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Cells of the top level at most, and bytes of block summaries that may be broadcast.
PIVOTS, SUMMARY_BYTES = 64, 32 << 20
#: What single precision may be off by, with room.
SLACK = 1e-3


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


class Tree:
    """Nested levels over the rows of ``x`` (unit vectors).

    ``levels[l] = (centre, parent, radius)``: rows that are centres, the node of the
    level above that each lies in, and how far its farthest descendant is. A
    centre stays one on all levels below. The last level is the rows themselves.
    """

    def __init__(self, x: np.ndarray, levels: bytes | None = None):
        self.x, self.x4 = x, x.astype(np.float32)
        self.levels = pickle.loads(levels) if levels else []
        if not levels:
            self.build()

    def build(self) -> None:
        n = len(self.x)
        near = self.x4 @ self.x4.T
        node = np.zeros(n, int)  # of each row on the level above
        centres = np.zeros(1, int)
        self.levels = [(centres, np.zeros(1, int), np.array([chord(near[0]).max()], np.float32))]
        for r in RADII:
            least = 1 - r * r / 2
            new_node, new_centres, parents, radii = np.zeros(n, int), [], [], []
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(len(centres) + 1))
            for p, c in enumerate(centres):
                rest = order[bounds[p] : bounds[p + 1]]
                while len(rest):
                    cos = near[c, rest]
                    inside = cos >= least
                    inside |= rest == c
                    new_node[rest[inside]] = len(new_centres)
                    new_centres.append(c)
                    parents.append(p)
                    radii.append(float(chord(cos[inside].min())) if inside.sum() > 1 else 0.0)
                    rest = rest[~inside]
                    c = rest[0] if len(rest) else c
            node, centres = new_node, np.array(new_centres)
            self.levels.append((centres.astype(np.int32), np.array(parents, np.int32), np.array(radii, np.float32)))
        self.levels.append((np.arange(n, dtype=np.int32), node.astype(np.int32), np.zeros(n, np.float32)))

    def dumped(self) -> bytes:
        """The levels, to be made once per block and not with every partner."""
        return pickle.dumps(self.levels, protocol=5)


def dual(a: Tree, b: Tree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs with a cosine of ``least`` or more: node pairs whose balls are too far apart go, level by level."""
    reach = float(chord(np.array(least)))
    i, j = np.zeros(1, int), np.zeros(1, int)
    for level in range(1, len(a.levels)):
        ca, pa_, ra = a.levels[level]
        cb, pb, rb = b.levels[level]
        ka, kb = np.bincount(pa_, minlength=len(a.levels[level - 1][0])), np.bincount(pb, minlength=len(b.levels[level - 1][0]))
        size = int((ka[i] * kb[j]).sum())
        got_i, got_j = [], []
        oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
        sa, sb = np.concatenate([[0], np.cumsum(ka)]), np.concatenate([[0], np.cumsum(kb)])
        if 8 * size >= len(ca) * len(cb):
            # most of the matrix: in blocks of rows, masked by the pairs of the level above
            alive = np.zeros((len(ka), len(kb)), bool)
            alive[i, j] = True
            every = bool(alive.all())
            for cols in (np.flatnonzero(rb == 0), np.flatnonzero(rb > 0)):
                xb = b.x4[cb[cols]].T
                for s in range(0, len(ca), 512):
                    e = slice(s, s + 512)
                    # the same bound on the cosine: chord <= reach + both radii
                    far = reach + SLACK + ra[e, None] + (rb[cols][None, :] if rb[cols].any() else np.float32(0))
                    ok = a.x4[ca[e]] @ xb >= (1 - np.minimum(far, 2) ** 2 / 2).astype(np.float32) - np.float32(1e-5)
                    x, y = np.nonzero(ok)
                    if not every:
                        own = alive[pa_[e][x], pb[cols[y]]]
                        x, y = x[own], y[own]
                    got_i.append(x + s)
                    got_j.append(cols[y])
        else:
            for s in range(0, len(i), 50_000):
                na, nb = ka[i[s : s + 50_000]], kb[j[s : s + 50_000]]
                total = na * nb
                at = np.arange(total.sum()) - np.repeat(np.concatenate([[0], np.cumsum(total)[:-1]]), total)
                wide = np.repeat(nb, total)
                x = oa[np.repeat(sa[i[s : s + 50_000]], total) + at // wide]
                y = ob[np.repeat(sb[j[s : s + 50_000]], total) + at % wide]
                for u in range(0, len(x), 200_000):
                    xu, yu = x[u : u + 200_000], y[u : u + 200_000]
                    d = chord(np.einsum("ij,ij->i", a.x4[ca[xu]], b.x4[cb[yu]])) - ra[xu] - rb[yu]
                    ok = d <= reach + SLACK
                    got_i.append(xu[ok])
                    got_j.append(yu[ok])
        i, j = np.concatenate(got_i or [np.zeros(0, int)]), np.concatenate(got_j or [np.zeros(0, int)])
        if not len(i):
            return
    if a is b:
        i, j = i[i < j], j[i < j]
    for s in range(0, len(i), 200_000):
        x, y = i[s : s + 200_000], j[s : s + 200_000]
        ok = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= least
        yield x[ok], y[ok]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; links are pairs of vectors with a cosine of ``least`` or more.

    Equal vectors are one class from the start, counted by its size. Classes go
    to cells around pivots (a bounded sample that only shapes the cells), cells
    to blocks of bounded size, each with a cover tree. Block pairs whose
    covering balls are too far apart go first, then the two trees are traversed
    together. A task holds two blocks; it hands on link counts and, for
    connectivity, one edge per vector, never all pairs of a dense group.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of different lengths. Components are
    doubles, products too. Repeated ids are one vector, the one that comes first by value.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(f"`{id_col}`").cast("long").alias("d")).distinct()
    v = vectors_of(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0) & F.col("d").isNotNull())
    keyed = v.groupBy("d").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    keyed = stage(keyed.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.reverse("v"), F.lit(1))), "vectors")
    classes = stage(keyed.groupBy("k1", "k2", "dim").agg(F.min("d").alias("rep"), F.count("*").alias("m")), "classes")
    reps = classes.select(F.col("rep").alias("d"), "m").join(keyed.select("d", "v", "dim"), "d")
    dims = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length of vector
    pivots = {}
    for dim, n in dims.items():
        wanted = max(1, min(PIVOTS, n * dim * 4 // BLOCK_BYTES // 2))
        pick = keyed.where(F.col("dim") == dim).orderBy("k1", "d").limit(wanted).select("v").collect()
        pivots[dim] = unit(np.array([r.v for r in pick], np.float64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            flat, at = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(dim)])
            cell = np.zeros(b.num_rows, np.int64)
            for k in set(dim.tolist()):
                own = np.flatnonzero(dim == k)
                x = unit(np.stack([flat[at[i] : at[i + 1]] for i in own]))
                cell[own] = (x @ pivots[k].T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("m"), b.column("v"), b.column("dim"), pa.array(cell)], ["d", "m", "v", "dim", "cell"])

    inner = keyed.schema["v"].dataType.simpleString()
    placed = stage(reps.select("d", "m", "v", "dim").mapInArrow(place, f"d long, m long, v {inner}, dim int, cell long"), "cells")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()  # PIVOTS rows per length at most
    first, parts, names = {}, {}, 0
    for r in sorted(cells, key=lambda r: (r.dim, r.cell)):
        parts[r.dim, r.cell] = max(1, math.ceil(r.n * r.dim * 4 / BLOCK_BYTES))
        first[r.dim, r.cell] = names
        names += parts[r.dim, r.cell]
    plan = spark.createDataFrame([(d, c, first[d, c], p) for (d, c), p in parts.items()], "dim int, cell long, first long, parts int")
    blocks = placed.join(F.broadcast(plan), ["dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("d"), "parts"))
    blocks = stage(packed(blocks.select("block", "d", "m", "v", "dim"), ["block"], weights=True), "blocks")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = unit(unpacked(r["dim"], r["ids"], r["m"], r["data"])[2])
                c = x.mean(0)
                c = c / max(np.linalg.norm(c), 1e-12)
                row = [r["block"]], [r["dim"]], [r["ids"]], [r["m"]], [r["data"]], [Tree(x).dumped()], [c.tolist()], [float(np.sqrt(((x - c) ** 2).sum(1)).max())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()))], ["block", "dim", "ids", "m", "data", "tree", "c", "r"])

    blocks = stage(blocks.repartition("block").mapInArrow(grow, "block long, dim int, ids binary, m binary, data binary, tree binary, c array<double>, r double"), "trees")
    balls = blocks.select("block", "dim", "c", "r")
    widest = max(dims, default=1)
    ids = blocks.select("block", "dim")
    if names * (8 * widest + 24) <= SUMMARY_BYTES:  # the size is known: prune whole block pairs here
        held = balls.collect()
        reach = float(chord(np.array(least))) + SLACK
        partners = []
        for dim in dims:
            own = [r for r in held if r.dim == dim]
            if own:
                c, rad, name = np.array([r.c for r in own]), np.array([r.r for r in own]), np.array([r.block for r in own])
                for k in range(len(own)):
                    near = np.sqrt(((c - c[k]) ** 2).sum(1)) - rad - rad[k] <= reach
                    partners.append((int(name[k]), sorted(name[near & (name >= name[k])].tolist())))
        pairs = spark.createDataFrame(partners, "a long, bs array<long>").select("a", F.explode("bs").alias("b"))
    else:
        # every block meets all later ones of its length in the traversal itself
        span = plan.groupBy("dim").agg((F.max(F.col("first") + F.col("parts")) - 1).alias("hi"))
        pairs = ids.join(F.broadcast(span), "dim").select(F.col("block").alias("a"), F.explode(F.sequence("block", "hi")).alias("b"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("block")).distinct()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, levels = {}, {}
        for batch in batches:
            for r in batch.select(["block", "dim", "ids", "m", "data", "tree"]).to_pylist():
                got[r["block"]], levels[r["block"]] = unpacked(r["dim"], r["ids"], r["m"], r["data"]), r["tree"]
        a, b = key[0].as_py(), key[1].as_py()
        if a not in got or b not in got:
            return
        trees = {k: Tree(unit(x), levels[k]) for k, (_, _, x) in got.items()}
        names_ = np.concatenate([got[a][0], got[b][0]]) if a != b else got[a][0]
        m = np.concatenate([got[a][1], got[b][1]]) if a != b else got[a][1]
        shift = len(got[a][0]) if a != b else 0
        links, group = np.zeros(len(names_), np.int64), np.arange(len(names_))
        for i, j in dual(trees[a], trees[b], least):
            j = j + shift
            np.add.at(links, i, m[j])
            np.add.at(links, j, m[i])
            tie_i, tie_j = np.concatenate([i, np.arange(len(group))]), np.concatenate([j, group])
            group = labels(len(group), tie_i, tie_j)
        has = np.flatnonzero(links)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(names_[has]), pa.array(links[has]), pa.array(names_[group[has]])], ["d", "n", "b"])

    found = stage(sides.join(blocks.drop("c", "r"), "block").groupBy("a", "b").applyInArrow(meet, "d long, n long, b long"), "found")
    sums = found.groupBy("d").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("d").alias("a"), "b"))
    named = classes.join(sums.withColumnRenamed("d", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k1", "k2", "dim", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.join(keyed.select("d", "k1", "k2", "dim").join(named, ["k1", "k2", "dim"]), "d", "left")
    comp_col = F.coalesce("component_id", "d")
    return out.select(F.col("d").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_col.alias("component_id"), (F.col("d") == comp_col).alias("kept"))
