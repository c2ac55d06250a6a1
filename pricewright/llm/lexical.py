"""Ranked lexical search by sort-based accumulation.

Documents are read once. What a task accumulates are (item, document, impact)
entries in plain arrays: a radix sort brings equal pairs together and one
reduction sums them up; no table of accumulators is held.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .ordering import running

#: Bytes of items' terms that one pass over the documents looks for; more take several passes.
ITEM_BYTES = 16 << 20
#: Entries that are sorted at once; bytes of a text that are split into terms at once.
ENTRIES, TEXT_BYTES = 1 << 21, 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a list per ``TEXT_BYTES`` or so: runs of ASCII letters and digits and all non-ASCII characters, A-Z in lower case."""
    text, at = (text or b"").lower(), 0  # of bytes, so that A-Z alone change
    while at < len(text):
        gap = _GAP.search(text, at + TEXT_BYTES)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def _counts(text: bytes | None, known: dict[bytes, int] | None) -> tuple[int, Counter]:
    n, found = 0, Counter()
    for run in terms(text):
        n += len(run)
        found.update(run if known is None else map(known.get, run))
    if known is not None:
        found.pop(None, None)
    return n, found


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys of ``bits`` bits, 16 at a time from the lowest (numpy sorts 16-bit values by radix)."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of the distinct pairs, sorted by item, then doc."""
    if not len(item):
        return item, doc, impact
    low = max(1, int(doc.max()).bit_length())
    keys = (item.astype(np.uint64) << np.uint64(low)) | doc.astype(np.uint64)
    order = radix_order(keys, low + max(1, int(item.max()).bit_length()))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    score = np.add.reduceat(impact[order], first)
    keys = keys[first]
    return (keys >> np.uint64(low)).astype(np.int64), (keys & np.uint64((1 << low) - 1)).astype(np.int64), score


class Heaps:
    """The ``k`` best (score, id) of each item; equal scores by smaller id, no id last."""

    def __init__(self, k: int):
        self.k = k
        self.of: dict[int, list[tuple[int, bool, int]]] = {}

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        heap = self.of.setdefault(item, [])
        if len(heap) == self.k:
            at = np.flatnonzero(score >= heap[0][0])
        else:
            at = np.arange(len(score))
        if len(at) > self.k:
            at = at[score[at] >= np.partition(score[at], len(at) - self.k)[len(at) - self.k]]
        for s, h, d in zip(score[at].tolist(), has_id[at].tolist(), (-ids[at]).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, h, d))
            elif (s, h, d) > heap[0]:
                heapq.heapreplace(heap, (s, h, d))


def _matches(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(d, n, t, tf): number of terms and, of the known ones, which and how often; documents without a term are left out."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n, t, tf, keep = [], [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                count, found = _counts(text.as_py(), known)
                if count:
                    keep.append(i)
                    n.append(count)
                    t.append(np.fromiter(found.keys(), np.int32, len(found)))
                    tf.append(np.fromiter(found.values(), np.int64, len(found)))
            if keep:
                at = np.concatenate([[0], np.cumsum([len(x) for x in t])])
                lists = [pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), np.concatenate(x)) for x in (t, tf)]
                d = b.column("d").take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([d, pa.array(n, pa.int64()), lists[0].cast(pa.list_(pa.int32())), lists[1].cast(pa.list_(pa.int64()))], ["d", "n", "t", "tf"])

    return docs.mapInArrow(match, "d long, n long, t array<int>, tf array<long>")


def _scored(matches: DataFrame, items: list[int], first: np.ndarray, of_item: np.ndarray, times: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, d, score): each task's ``k`` best documents of each item. ``first[t]:first[t + 1]`` are the places of term t in ``of_item`` and ``times``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Heaps(k)
        for b in batches:
            lists, tfs = b.column("t"), b.column("tf")
            at, t, tf = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(), tfs.flatten().to_numpy()
            at = at - at[0]
            ids, has = b.column("d").fill_null(0).to_numpy(), ~np.asarray(b.column("d").is_null())
            m = 75 + (25 * b.column("n").to_numpy() * n_docs) // n_terms
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            impact = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            size = first[t + 1] - first[t]
            total = np.concatenate([[0], np.cumsum(size)])
            # whole documents, as many as make up a run of entries; one at least
            ends, a = total[at], 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1)
                p = slice(at[a], at[z])
                which = np.repeat(first[t[p]] - (total[p.start : p.stop] - total[p.start]), size[p]) + np.arange(total[p.stop] - total[p.start])
                item, row, sums = accumulate(of_item[which], np.repeat(doc[p] - a, size[p]), np.repeat(impact[p], size[p]) * times[which])
                keep = sums > 0
                item, row, sums = item[keep], row[keep] + a, sums[keep]
                if len(item):
                    edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
                    for x, y in zip(edge[:-1], edge[1:]):
                        best.add(int(item[x]), sums[x:y], ids[row[x:y]], has[row[x:y]])
                a = z
        rows = [(items[i], -d if h else None, s) for i, heap in best.of.items() for s, h, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item", "d", "score"])

    return matches.mapInArrow(score, "item long, d long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents that score highest for each item, those above 0; equal scores by ascending id.

    1. Items become counted terms. Their running sizes cut them into blocks of ``ITEM_BYTES``; a block's terms go
       to all tasks, and each block is one pass over the documents. One block is the rule.
    2. A pass splits each whole text and keeps, per document, its number of terms and the counts of those that
       items ask for. From that table come the numbers of documents and terms and each term's document frequency.
    3. Its second reading computes impacts in 64-bit whole numbers. Entries (item, document, impact) of a run of
       documents are concatenated, radix sorted by packed key and summed; heaps keep an item's ``k`` best of a task.
    4. The heaps' rows are range-partitioned by item, score and id; what lies before a row in its item is its
       rank, so that no item's rows meet in one task.

    Null and empty texts have no terms: such documents count nowhere, such items return no rows. Every row of
    ``docs`` is a document; rows that repeat an id are ranked each, rows without an id come last among equal
    scores. Items without an id take no part; of rows that repeat an item's id the smallest text counts.
    Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item IS NOT NULL").groupBy("item").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, c) for i, text in zip(b.column("item").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()) for t, c in _counts(text, None)[1].items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "c"])

    asked = stage(asked.mapInArrow(count, "item long, term binary, c long"), "asked")
    sizes = asked.groupBy("item").agg(F.sum(F.octet_length("term") + 64).alias("bytes"))
    blocks = stage(running(sizes, [], [F.col("item")], before=F.col("bytes")).select("item", F.floor(F.col("before") / ITEM_BYTES).cast("int").alias("block")), "blocks")
    out, size = None, None
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():
        part = asked.join(blocks.where(F.col("block") == block), "item", "left_semi").toArrow()
        names, of = np.unique(part.column("item").to_numpy(), return_inverse=True)
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(t, len(known)) for t in part.column("term").to_pylist()], np.int64)
        order = np.argsort(which, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(known)))])
        matches = stage(_matches(docs, known), "matches")
        size = size or matches.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            break
        df = matches.select(F.explode("t").alias("t")).groupBy("t").count().toArrow()  # a row per term of the block
        held = np.zeros(len(known), np.int64)
        held[df.column("t").to_numpy()] = df.column("count").to_numpy()
        w = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * x + 1))) for x in held.tolist()], np.int64)
        found = _scored(matches, names.tolist(), first, of[order], part.column("c").to_numpy()[order], w, size.docs, size.terms, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, d long, score long")
    out = stage(out, "best")  # dealing by ranges reads its rows twice
    ranked = running(out, ["item"], [F.col("score").desc(), F.col("d").asc_nulls_last()], before=F.lit(1))
    return ranked.where(F.col("before") < k).select(F.col("item").alias(item_col), (F.col("before") + 1).cast("int").alias("rank"), F.col("d").alias(id_col), "score")
