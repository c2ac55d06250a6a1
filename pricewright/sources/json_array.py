"""One huge JSON document as rows: byte ranges are read by many tasks, none holds the document.

Spark's text source cuts a file into splits, with ``}`` as the end of a line. Where a split begins, nobody
knows whether that lies inside a string, or inside which arrays. A first pass scans every split under both
assumptions about strings and says what it closes and opens; the driver puts these short summaries, one a split, together in
order. A second pass scans each split from its true state and cuts out the elements of the wanted array. Those
that cross a border come in pieces and are joined by the split in which they begin.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Where a feed keeps its rows.
WRAPPERS = ("items", "data", "result", "rows")

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*("?)|[{}\[\]:,]', re.S)
_REST = re.compile(rb'(?:[^"\\]|\\.)*("?)', re.S)


class Scanner:
    """Tokens of a document that comes in chunks which end with ``}``, and the containers that are open.

    ``stack`` holds (bracket, key) of each. Of a scanner that starts anywhere it holds what was opened since; ``closed`` counts what was closed of before.
    """

    def __init__(self, in_string: bool, stack: list[tuple[str, str]] | None = None):
        self.in_string, self.stack, self.closed = in_string, list(stack or []), 0
        self.text: bytes | None = None  # the last string, a key if a colon follows
        self.key = ""

    def tokens(self, chunk: bytes) -> Iterator[tuple[bytes, int]]:
        """(bracket, where it stands): ``stack`` is as before an opening and as after a closing one."""
        at = 0
        if self.in_string:
            m = _REST.match(chunk)
            at, self.in_string = m.end(), not m[1]
        for m in _TOKEN.finditer(chunk, at):
            c = chunk[m.start() : m.start() + 1]
            if c == b'"':
                self.in_string, self.text = not m[1], m.group()
            elif c == b":":
                self.key = _word(self.text)
            elif c == b",":
                self.key = ""
            elif c in b"{[":
                yield c, m.start()
                self.stack.append((c.decode(), self.key))
                self.key = ""
            else:
                if self.stack:
                    self.stack.pop()
                else:
                    self.closed += 1
                self.key = ""
                yield c, m.start()


def _word(raw: bytes | None) -> str:
    try:
        return json.loads(raw or b'""')
    except ValueError:
        return ""


def path_of(stack: Sequence[tuple[str, str]]) -> str:
    """Keys from below the root to the innermost container, an element of an array as an empty one."""
    return ".".join(key for _, key in stack[1:])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, where its split starts, bytes): the lines of a batch and split in one, with the ends that the reader took."""
    for b in batches:
        files, starts, lines = (b.column(c) for c in ("file", "start", "line"))
        keys = list(zip(files.to_pylist(), starts.to_pylist()))
        a = 0
        while a < len(keys):
            z = a
            while z < len(keys) and keys[z] == keys[a]:
                z += 1
            yield *keys[a], b"}".join(lines.slice(a, z - a).to_pylist()) + b"}"
            a = z


def _summaries(lines: DataFrame) -> list:
    """Per split and assumption: whether it ends in a string, what it closes and opens, and the arrays it opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[list[Scanner], list[set]]] = {}
        for file, start, chunk in _chunks(batches):
            scanners, arrays = seen.setdefault((file, start), ([Scanner(False), Scanner(True)], [set(), set()]))
            for scanner, found in zip(scanners, arrays):
                for c, _ in scanner.tokens(chunk):
                    if c == b"[":
                        found.add((scanner.closed, tuple(k for _, k in scanner.stack), scanner.key))
        if seen:
            out = [(f, s, json.dumps([[x.in_string, x.closed, x.stack, sorted(a)] for x, a in zip(*state)])) for (f, s), state in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "start", "summary"])

    return lines.mapInArrow(run, "file string, start long, summary string").collect()


def _states(rows: list, at: Sequence[str] | None) -> dict[str, dict]:
    """Per file: the depth of the wanted array's elements, its path, and per split its state and the split where an open element began."""
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r.file, []).append((r.start, json.loads(r.summary)))
    out = {}
    for file, splits in files.items():
        stack: list[tuple[str, str, int]] = []
        in_string, states, paths = False, {}, set()
        for start, either in sorted(splits):
            ends, closed, opened, arrays = either[in_string]
            states[start] = (in_string, list(stack))
            for n, keys, key in arrays:
                before = [k for _, k, _ in stack[: len(stack) - n]] + list(keys)
                paths.add((".".join([*before, key][1:]), len(before)))
            stack = stack[: max(0, len(stack) - closed)] + [(c, k, start) for c, k in opened]
            in_string = ends
        wanted = _wanted(paths, at)
        if wanted:
            out[file] = {"path": wanted[0], "depth": wanted[1] + 1, "states": states}
    return out


def _wanted(paths: set[tuple[str, int]], at: Sequence[str] | None) -> tuple[str, int] | None:
    """The first of ``at`` that is there; else the root, else the outermost array under a name of ``WRAPPERS``, in their order."""
    if at is not None:
        return next((p for want in at for p in sorted(paths) if p[0] == want), None)
    rank = lambda p: (p[1], WRAPPERS.index(p[0].split(".")[-1]))
    return ("", 0) if ("", 0) in paths else min((p for p in paths if p[0].split(".")[-1] in WRAPPERS), key=rank, default=None)


def _elements(lines: DataFrame, plan: dict[str, dict]) -> DataFrame:
    """(file, origin, start, done, text): whole elements (origin null), and pieces by the split in which their element begins; ``done``: the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners: dict[tuple[str, int], Scanner] = {}
        held: dict[tuple[str, int], tuple[int, list[bytes]]] = {}  # the open element: where it began, its bytes so far
        for file, start, chunk in _chunks(batches):
            want, out = plan.get(file), []
            if want is None:
                continue
            here, depth = (file, start), want["depth"]
            if here not in scanners:
                in_string, stack = want["states"][start]
                scanners[here] = Scanner(in_string, [(c, k) for c, k, _ in stack])
                if len(stack) > depth and path_of([x[:2] for x in stack[:depth]]) == want["path"] and stack[depth - 1][0] + stack[depth][0] == "[{":
                    held[here] = (stack[depth][2], [])
            scanner, a = scanners[here], 0  # what is held of this chunk begins at a
            for c, i in scanner.tokens(chunk):
                if c == b"{" and len(scanner.stack) == depth and scanner.stack[-1][0] == "[" and path_of(scanner.stack) == want["path"]:
                    held[here], a = (start, []), i
                elif c == b"}" and here in held and len(scanner.stack) == depth:
                    origin, parts = held.pop(here)
                    out.append((file, None if origin == start else origin, start, True, b"".join([*parts, chunk[a : i + 1]])))
            if here in held:
                held[here][1].append(chunk[a:])
            if out:
                yield _batch(out)
        rest = [(file, origin, start, False, b"".join(parts)) for (file, start), (origin, parts) in held.items()]
        if rest:
            yield _batch(rest)

    return lines.mapInArrow(run, "file string, origin long, start long, done boolean, text binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "origin", "start", "done", "text"])


def read_json_array(spark: SparkSession, path: str, schema: StructType, at: Sequence[str] | None = None) -> DataFrame:
    """The objects of one array of each file: a root array, or one under ``items``, ``data``, ``result`` or ``rows`` at any depth.

    ``at``: key paths to look under instead, such as ``root.goods.good``, the first that is there.
    Elements that are no objects are left out; what can't be parsed gives no row. A file that is cut off
    gives its whole elements. Splits follow ``spark.sql.files.maxPartitionBytes``; the driver holds a short row per split.
    Keys that hold a ``}`` are not told from empty ones where they cross a border.
    """
    text = spark.read.option("lineSep", "}").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    plan = _states(_summaries(lines), at)
    found = _elements(lines, plan)
    # pieces are a few a split; whole elements aren't moved
    joined = found.where("origin IS NOT NULL").groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", F.col("text").cast("string").alias("text")))).alias("p"), F.bool_or("done").alias("done")).where("done")
    texts = found.where("origin IS NULL").select(F.col("text").cast("string").alias("text")).unionByName(joined.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return texts.select(F.from_json("text", schema).alias("r")).where("r IS NOT NULL").select("r.*")
