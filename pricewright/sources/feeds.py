"""Supplier feeds in JSON, NDJSON, CSV, workbooks and HTML tables as DataFrames."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from itertools import chain
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .json_array import read_json_array

CP1251 = "windows-1251"


def _head(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of one file and no more, by the file system that Spark has for its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, fs.getFileStatus(at).getLen())))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """xlsx, csv, ndjson or json: by suffix, then by the first bytes."""
    low = path.lower()
    for suffix, kind in ((".xlsx", "xlsx"), (".csv", "csv"), (".ndjson", "ndjson"), (".jsonl", "ndjson")):
        if low.endswith(suffix):
            return kind
    head = _head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n")
    if head[:2] == b"PK":
        return "xlsx"
    if head[:1] == b"[":
        return "json"
    if head[:1] == b"{":
        return "ndjson" if re.match(rb"\{.*\}\s*\n\s*\{", head) else "json"
    return "csv"


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every byte of the file is UTF-8; checked line by line on the executors, as lines come undecoded."""
    return not spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()


def csv_options(head: bytes, utf8: bool) -> dict[str, str]:
    """Encoding (UTF-8 or cp1251) and the most frequent delimiter of the first 4096 characters."""
    sample = head.decode("utf-8-sig" if utf8 else "cp1251", "ignore")[:4096]
    sep = max(",;\t", key=sample.count)
    return {"sep": sep if sep in sample else ";", "encoding": "UTF-8" if utf8 else CP1251}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header. Spark reads no cp1251, so that is read as Latin-1, byte by byte, and translated."""
    options = csv_options(_head(spark, path, 4 * 4096 + 3), is_utf8(spark, path))
    if options["encoding"] != CP1251:
        return spark.read.options(header=True, quote='"', escape='"', **options).csv(path)
    options["encoding"] = "ISO-8859-1"
    rows = spark.read.options(header=True, quote='"', escape='"', **options).csv(path)
    high = [b for b in range(128, 256) if b != 0x98]
    latin, cyrillic = "".join(map(chr, high)), bytes(high).decode("cp1251")
    table = str.maketrans(latin, cyrillic)
    return rows.select(*[F.translate(F.col(f"`{c}`"), latin, cyrillic).alias(c.translate(table)) for c in rows.columns])


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line; blank lines and what is no object are left out."""
    raw = spark.read.text(path).where(F.trim("value").startswith("{"))
    return raw.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    kind = sniff(spark, path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    return read_ndjson(spark, path, schema) if kind == "ndjson" else read_json_array(spark, path, schema)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[tuple[int, list[str | None]]]]]:
    """(name, (row number, cells) one after the other) of each sheet of a workbook, by the standard library alone; a sheet isn't held as a whole."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, si in ElementTree.iterparse(f):
                    if si.tag == f"{_MAIN}si":
                        shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
                        si.clear()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[s.get(f"{_REL}id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                yield s.get("name"), _rows_of(f, shared)


def _rows_of(f, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    n = 0
    for _, row in ElementTree.iterparse(f):
        if row.tag != f"{_MAIN}row":
            continue
        n = int(row.get("r", n + 1))
        cells: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            at = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(ch) - 64
            at = at or len(cells) + 1
            cells += [None] * (at - len(cells))
            v = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
            cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        row.clear()
        yield n, cells


def _header(rows: Iterator[tuple[int, list[str | None]]], known: frozenset[str], scan: int) -> tuple[list[str], list[tuple[int, list[str | None]]]]:
    """The header's cells and the rows looked at that follow it: of the first ``scan`` rows the one with most known words, two at least; else the first that isn't blank."""
    seen = []
    for i, c in rows:
        if any((x or "").strip() for x in c):
            seen.append((i, c))
        if i >= scan and seen:
            break
    words = [sum(" ".join((x or "").lower().split()) in known for x in c) for _, c in seen]
    if not seen:
        return [], []
    best = words.index(max(words)) if max(words) >= 2 else 0
    return [(x or "").strip() or f"column_{k + 1}" for k, x in enumerate(seen[best][1])], seen[best + 1 :]


def read_xlsx(spark: SparkSession, path: str, known: frozenset[str] = frozenset(), scan: int = 25) -> DataFrame:
    """Workbook rows as (file, sheet, _row, cells map by header, sheet_no, headers); ``known``: lower case words by which a header row is told from what stands above it.

    Files are read by Spark's binary source, so any store will do; a workbook is one task's work, its sheets are read row by row.
    """

    def run(batches):
        import pandas as pd

        cols = ["file", "sheet", "_row", "cells", "sheet_no", "headers"]
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                for no, (name, rows) in enumerate(sheets(content)):
                    head, first = _header(rows, known, scan)
                    out = []
                    for i, c in chain(first, rows):
                        if any((x or "").strip() for x in c):
                            out.append((path_, name, i, {h: v for h, v in zip(head, c) if v is not None}, no, head))
                        if len(out) == 1000:
                            yield pd.DataFrame(out, columns=cols)
                            out = []
                    yield pd.DataFrame(out, columns=cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, _row int, cells map<string,string>, sheet_no int, headers array<string>")


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: a list of files, one partition each, for feeds landed page by page."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        paths = self.options.get("paths", "").split(",")

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition((i, p)) for i, p in enumerate(paths) if p]

            def read(self, partition):
                i, p = partition.value
                with open(p, encoding="utf-8") as f:
                    yield i, f.read()

        return Reader()


def html_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))


def html_cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<(t[dh])\b[^>]*>(.*?)</\1>"), F.lit(2))


def hidden_inputs(html: Column) -> Column:
    """name -> value of hidden inputs; the last of equal names stays."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<input\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)type\s*=\s*[\"']?(hidden|submit)"))
    pairs = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"(?i)name\s*=\s*[\"']([^\"']*)", 1).alias("k"), F.regexp_extract(t, r"(?i)value\s*=\s*[\"']([^\"']*)", 1).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: (p["k"] != "") & ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"])))


def max_page(html: Column) -> Column:
    """The largest number in page=N links, 1 at least."""
    return F.greatest(F.lit(1), F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)[?&;]page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))))
