"""Dates as Column expressions; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_date(c: Column, *patterns: str) -> Column:
    """The first pattern that reads the text; else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in patterns])


def expiry(c: Column) -> Column:
    """yyyy-MM-dd of an ISO text; the sentinel 0001-01-01 and what can't be read: empty."""
    d = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1)
    ok = F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull() & (d != "0001-01-01")
    return F.when(ok, d).otherwise("")


def lenient(c: Column) -> Column:
    return first_date(F.trim(c), "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def days_old(c: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, c), F.lit(0))


def list_status(active: Column, start: Column, end: Column, as_of: Column) -> Column:
    return F.when(~active, "inactive").when(start > as_of, "not_started").when(end < as_of, "expired").otherwise("active")


def cell_date(c: Column) -> Column:
    """A sheet's date: year first, or day first with points or slashes, or the number of days that workbooks store; else null."""
    t = F.trim(c)
    days = F.when(t.rlike(r"^\d{4,6}(\.0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), t.cast("double").cast("int")))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")], days)
