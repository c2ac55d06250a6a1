"""Price lists and reports as CSV, for spreadsheets and for other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_title, safe_cell

BOM = "﻿"


def safe(rows: DataFrame) -> DataFrame:
    """Every text cell against formula injection; numbers and dates as they are."""
    return rows.select(*[safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def wide(priced: DataFrame, rivals: DataFrame, product: str, titles: list[str], value: str = "price") -> DataFrame:
    """A priced list with a column per competitor title of a report; products without a price there stay empty.

    The titles are named beforehand, so the pivot is one aggregation.
    """
    cells = rivals.groupBy(product).pivot("title", titles).agg(F.min(value))
    return priced.join(cells, product, "left")


def titled(labels: Column) -> Column:
    return column_title(labels)


def write_csv(rows: DataFrame, path: str, sep: str = ";", bom: bool = True, mode: str = "overwrite") -> None:
    """Write as CSV parts with a header each, UTF-8; with ``bom`` the first header cell begins with the mark that spreadsheets look for.

    Rows are ordered by the caller; nothing is drawn into one task, so a report that has to be one file is coalesced before.
    """
    first, *rest = rows.columns
    named = rows.withColumnRenamed(first, BOM + first) if bom else rows
    safe(named).write.options(header=True, sep=sep, encoding="UTF-8", quote='"', escape='"', emptyValue="").mode(mode).csv(path)


def priced_rows(products: DataFrame, run: DataFrame, key: str, price: str = "price", log: str = "log") -> DataFrame:
    """Products that a run has priced, with the price and the run's remarks (an array of texts) as one text; blank remarks are left out."""
    said = F.array_join(F.filter(log, lambda x: F.trim(x) != ""), "; ")
    return products.join(run.select(key, price, said.alias(log)), key)
