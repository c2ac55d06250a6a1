"""Interval and as-of joins with small scale tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(rows: DataFrame, keys: list[str], *cols: str, name: str = "scale") -> DataFrame:
    """Scale rows as one sorted array per key: a look-up then is an expression, with no join of inequalities.

    A scale has a few rows per price format; the array is as long as that.
    """
    packed = F.array_sort(F.collect_list(F.struct(*cols))).alias(name)
    return rows.groupBy(*keys).agg(packed) if keys else rows.agg(packed)


def in_range(ranges: Column, value: Column) -> Column:
    """``ranges``: array<struct<cost_from, cost_to, percent>> by cost_from. Both ends count; the first
    range that holds the value wins; a value in none takes the last range."""
    hit = F.filter(ranges, lambda r: (value >= r["cost_from"]) & (r["cost_to"].isNull() | (value <= r["cost_to"])))
    return F.coalesce(F.get(hit, F.lit(0))["percent"], F.try_element_at(ranges, F.lit(-1))["percent"])


def in_range_or(ranges: Column, value: Column, fallback: Column) -> Column:
    """As ``in_range``; 0 and none take the fallback."""
    p = in_range(ranges, value)
    return F.coalesce(F.when(p != 0, p), fallback)


def as_of(steps: Column, value: Column, fallback: Column) -> Column:
    """``steps``: array<struct<price_from, percent>> by price_from: the last step at or below the value."""
    hit = F.filter(steps, lambda s: s["price_from"] <= value)
    return F.coalesce(F.try_element_at(hit, F.lit(-1))["percent"], fallback)


def invalid_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that are negative, turned round, or overlap the one before (an open end overlaps all that follow)."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(*keys).orderBy("cost_from", F.col("cost_to").asc_nulls_last())
    end = F.max(F.coalesce("cost_to", F.lit(1e18))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    why = F.when(F.col("cost_from") < 0, "negative").when(F.col("cost_to") <= F.col("cost_from"), "turned").when(end >= F.col("cost_from"), "overlap")
    return rows.withColumn("why", why).where("why IS NOT NULL")
