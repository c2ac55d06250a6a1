"""Workbooks (XLSX) of any number of rows: one per value of a column, split where a workbook would get too long.

The tasks build each workbook's bytes and Spark's own file sink puts them into place, so any store will do and lost
tasks are written again. Nothing but names passes through the driver.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch

# Names and limits of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
CELL = 32767
SHEET_ROWS = 1048576

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: The first style is plain, the second a date; the one format for marked cells is a green ground.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs>'
    '<dxfs count="1"><dxf><fill><patternFill patternType="solid"><fgColor rgb="FFC6EFCE"/><bgColor rgb="FFC6EFCE"/></patternFill></fill></dxf></dxfs></styleSheet>'
)


class Sheet:
    """Rows of one sheet. ``order``: how they stand; ``mark``: (column, least, greatest) whose cells get a green ground."""

    def __init__(self, rows: DataFrame, order: list[Column], mark: tuple[str, float, float] | None = None):
        self.rows, self.order, self.mark = rows, order, mark


def _text(c: Column) -> Column:
    clean = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return F.when(F.length(clean) > CELL, F.concat(F.left(clean, F.lit(CELL - 1)), F.lit("…"))).otherwise(clean)


def _cell(name: str, kind: T.DataType) -> tuple[str, Column]:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return "b", c.cast("int").cast("string")
    if isinstance(kind, T.DateType):
        return "d", F.datediff(c, F.lit("1899-12-30")).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "n", F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("string"))
    return ("n", c.cast("string")) if isinstance(kind, T.NumericType) else ("s", _text(c))


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i > 25 else "") + chr(65 + i % 26)


def _row(n: int, kinds: list[str], cells) -> str:
    out = []
    for i, (kind, v) in enumerate(zip(kinds, cells)):
        if v is None:
            continue
        at = f'r="{_letters(i)}{n}"'
        if kind == "s":
            out.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        else:
            out.append(f"<c {at}{' t="b"' if kind == 'b' else ' s="1"' if kind == 'd' else ''}><v>{v}</v></c>")
    return f'<row r="{n}">{"".join(out)}</row>'


class _Book:
    """One workbook, written sheet after sheet; rows come in the order of the sheets."""

    def __init__(self, plan: list[tuple]):
        self.plan, self.bytes, self.no, self.out = plan, io.BytesIO(), -1, None
        self.zip = zipfile.ZipFile(self.bytes, "w", zipfile.ZIP_DEFLATED)

    def add(self, no: int, cells) -> None:
        while self.no < no:
            self._next()
        self.n += 1
        self.out.write(_row(self.n, self.plan[no][2], cells).encode())

    def _next(self) -> None:
        self._end()
        self.no += 1
        _, names, _, _ = self.plan[self.no]
        self.out, self.n = self.zip.open(f"xl/worksheets/sheet{self.no + 1}.xml", "w"), 1
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        self.out.write(f'{_HEAD}<worksheet xmlns="{MAIN}">{pane}<sheetData>{_row(1, ["s"] * len(names), names)}'.encode())

    def _end(self) -> None:
        if self.out is None:
            return
        _, names, _, mark = self.plan[self.no]
        rule = ""
        if mark and self.n > 1:
            at = _letters(names.index(mark[0]))
            rule = f'<conditionalFormatting sqref="{at}2:{at}{self.n}"><cfRule type="cellIs" dxfId="0" priority="1" operator="between"><formula>{mark[1]}</formula><formula>{mark[2]}</formula></cfRule></conditionalFormatting>'
        self.out.write(f"</sheetData>{rule}</worksheet>".encode())
        self.out.close()

    def done(self) -> bytes:
        """The file without its last byte: that is the line end of Spark's text sink, which the file takes as its comment."""
        while self.no < len(self.plan) - 1:
            self._next()
        self._end()
        each = range(1, len(self.plan) + 1)
        sheets = "".join(f'<sheet name={quoteattr(p[0])} sheetId="{i}" r:id="rId{i}"/>' for i, p in zip(each, self.plan))
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each)
        kind, mime = f"{PACKAGE}/content-types", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{mime}.worksheet+xml"/>' for i in each)
        add = self.zip.writestr
        add("[Content_Types].xml", f'{_HEAD}<Types xmlns="{kind}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{mime}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{mime}.styles+xml"/>{parts}</Types>')
        add("_rels/.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        add("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets></workbook>')
        add("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="rId{len(self.plan) + 1}" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        add("xl/styles.xml", _STYLES)
        self.zip.comment = b"\n"
        self.zip.close()
        return self.bytes.getvalue()[:-1]


def _numbered(rows: DataFrame, aside: str, rows_per_book: int) -> DataFrame:
    """(key, book, sheet, at, cells): rows in the order of key, sheet and their own, and which workbook of its key a row is in.

    Rows are sorted into ranges and staged once, so their places stay; a place within the key is the
    place within the range, plus the rows of the key in earlier ranges. No key is drawn into one task.
    """
    spark = rows.sparkSession
    order = [c for c in rows.columns if c not in ("cells",)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "sheet", "cells", F.monotonically_increasing_id().alias("at")).write.parquet(aside)
    staged = spark.read.parquet(aside).withColumn("range", F.shiftright("at", 33))
    counts = staged.groupBy("key", "range").agg(F.count(F.when(F.col("sheet") >= 0, 1)).alias("n"), F.min("at").alias("first"), F.count(F.when(F.col("sheet") < 0, 1)).alias("marks"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") - F.col("marks")).alias("shift"))
    place = F.greatest(F.lit(0), F.col("at") + F.col("shift"))
    return staged.join(counts, ["key", "range"]).select("key", F.floor(place / rows_per_book).cast("int").alias("book"), "sheet", "at", "cells")


def write(spark: SparkSession, sheets: dict[str, Sheet], path: str, by: str | None = None, rows_per_book: int = 100_000) -> list[str]:
    """Write the sheets as workbooks into the new folder ``path`` and return their names.

    With ``by``, a column of all sheets that isn't written, each of its values gets a workbook of its name (null: `none`);
    without, there is one, `book`, even if no sheet has rows. More than ``rows_per_book`` rows make several workbooks, `-001`, `-002` and so on. Every workbook has all sheets,
    header first. Rows that are null in all of ``order`` come first. Numbers, dates and booleans are typed cells, all else
    is text, kept as it is but for characters that XML can't hold and for what exceeds 32,767 characters, which the
    format can't hold either (`…` stands in its place). NaN and infinities are blank. The folder appears as a whole, or not at all.
    """
    if not 0 < rows_per_book < SHEET_ROWS:
        raise ValueError("rows_per_book must be from 1 to 1,048,575")
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        raise ValueError(f"{path} exists")
    plan, parts = [], []
    depth = max(len(s.order) for s in sheets.values())
    for no, (name, s) in enumerate(sheets.items()):
        fields = [f for f in s.rows.schema.fields if f.name != by]
        cells = [_cell(f.name, f.dataType) for f in fields]
        plan.append((name, [f.name for f in fields], [k for k, _ in cells], s.mark))
        order = [x for i in range(depth) for x in _keys(s.rows, s.order[i] if i < len(s.order) else None, i)]
        key = F.lit("book") if by is None else F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("none"))
        parts.append(s.rows.select(key.alias("key"), F.lit(no).alias("sheet"), *order, F.array(*[c for _, c in cells]).cast("array<string>").alias("cells")))
    if by is None:
        parts.append(spark.range(1).select(F.lit("book").alias("key"), F.lit(-1).alias("sheet"), *[F.lit(None).cast(t).alias(c) for c, t in parts[0].dtypes[2:]]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    placed = _numbered(rows, scratch(spark, "workbook-rows"), rows_per_book)

    def build(batches) -> Iterator:
        import pandas as pd

        book = now = None
        named = lambda: f"{quote(now[0], safe='')}~{now[1]:06d}"
        for pdf in batches:
            for key, no, sheet, cells in zip(pdf["key"], pdf["book"], pdf["sheet"], pdf["cells"]):
                if (key, no) != now:
                    if book:
                        yield pd.DataFrame({"book": [named()], "content": [book.done()]})
                    book, now = _Book(plan), (key, no)
                if sheet >= 0:
                    book.add(sheet, cells)
        if book:
            yield pd.DataFrame({"book": [named()], "content": [book.done()]})

    books = placed.repartition("key", "book").sortWithinPartitions("key", "book", "at").select("key", "book", "sheet", "cells").mapInPandas(build, "book string, content binary")
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    books.select("book", F.col("content").cast("string").alias("value")).write.partitionBy("book").option("lineSep", "\n").option("compression", "none").text(aside)
    return _publish(spark, fs, aside, path)


def _keys(rows: DataFrame, c: Column | None, i: int) -> list[Column]:
    """A sort key as a number and a text, of which one is null, so that all sheets have the same columns."""
    null = F.lit(None)
    if c is None:
        return [null.cast("double").alias(f"n{i}"), null.cast("string").alias(f"s{i}")]
    kind = rows.select(c).schema[0].dataType
    number = isinstance(kind, (T.NumericType, T.BooleanType))
    return [(c.cast("double") if number else null.cast("double")).alias(f"n{i}"), (null.cast("string") if number else c.cast("string")).alias(f"s{i}")]


def _publish(spark: SparkSession, fs, aside: str, path: str) -> list[str]:
    Path = spark._jvm.org.apache.hadoop.fs.Path
    found: dict[str, list[tuple[str, object]]] = {}
    for folder in fs.listStatus(Path(aside)):
        name = folder.getPath().getName()
        if name.startswith("book="):
            key, no = unquote(name[5:]).rsplit("~", 1)
            file = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            found.setdefault(re.sub(r'[\x00-\x1f/\\:*?"<>|]', "_", unquote(key)), []).append((f"{key}~{no}", file))
    ready, names = Path(f"{aside}/ready"), []
    fs.mkdirs(ready)
    for stem, files in sorted(found.items()):
        for i, (_, file) in enumerate(sorted(files, key=lambda x: x[0]), 1):
            names.append(f"{stem}.xlsx" if len(files) == 1 else f"{stem}-{i:03d}.xlsx")
            fs.rename(file, Path(ready, names[-1]))
    if not fs.rename(ready, Path(path)):
        raise ValueError(f"{path} exists")
    fs.delete(Path(aside), True)
    return names
