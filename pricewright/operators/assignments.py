"""Which sources a price format uses, and what carries over from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import best_per_key


def propagate(existing: DataFrame, formats: DataFrame, sources: DataFrame, fmt: str = "format", src: str = "source") -> DataFrame:
    """Every format with every source of a short list: what happens to each pair (create, reactivate, reuse).

    Both lists are configuration; their product is the result itself.
    """
    grid = formats.select(fmt).join(F.broadcast(sources.select(src)), how="cross")
    now = existing.select(fmt, src, F.col("is_active").alias("_a"))
    return grid.join(now, [fmt, src], "left").select(fmt, src, F.when(F.col("_a").isNull(), "create").when(F.col("_a"), "reuse").otherwise("reactivate").alias("action"))


def reconcile(existing: DataFrame, selected: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """Active is what is selected; what is missing is added with the default coefficient."""
    now = existing.select(*keys, F.col("coefficient").alias("_c"), F.lit(True).alias("_e"))
    want = selected.select(*keys, F.lit(True).alias("_s"))
    out = now.join(want, keys, "full")
    return out.select(*keys, F.coalesce("_c", default).alias("coefficient"), F.coalesce("_s", F.lit(False)).alias("is_active"), F.when(F.col("_e").isNull(), "inserted").when(F.col("_s").isNull(), "deactivated").otherwise("kept").alias("change"))


def carry_over(new: DataFrame, old: DataFrame, key_lists: tuple[Column, Column], value: str, row: str) -> DataFrame:
    """Give new rows the old rows' value by the first identity key that both have (keys in order of trust)."""
    a = new.select(row, F.posexplode(key_lists[0]).alias("_i", "_k")).where("_k IS NOT NULL")
    b = old.select(F.explode(key_lists[1]).alias("_k"), value).where(f"_k IS NOT NULL AND {value} IS NOT NULL").groupBy("_k").agg(F.min(value).alias(value))
    best = a.join(b, "_k").groupBy(row).agg(F.min_by(value, "_i").alias(value))
    return new.join(best, row, "left")


def source_key(platform: Column, account: Column, external: Column, name: Column) -> Column:
    """A stable id: the account's list, else the platform's, else the name's."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return (
        F.when(~blank(external) & ~blank(account), F.concat(F.lit("account:"), F.trim(account), F.lit(":plk:"), F.trim(external)))
        .when(~blank(external), F.concat(F.lower(F.trim(platform)), F.lit(":"), F.trim(external)))
        .when(~blank(name), F.concat(F.lit("name:"), F.lower(F.trim(name))))
    )


def visibility(status: Column, items: Column) -> Column:
    """populated, failed_empty, empty_success or placeholder."""
    return F.when(items > 0, "populated").when(status.isin("failed", "error"), "failed_empty").when(status == "success", "empty_success").otherwise("placeholder")


def merge_duplicates(rows: DataFrame, keys: list[str], row: str, *rank: Column) -> DataFrame:
    """(row, winner): the best row of each key takes the places of the others."""
    best = best_per_key(rows, keys, *rank).select(*keys, F.col(row).alias("winner"))
    return rows.join(best, keys).select(row, "winner")


def applied_differs(template: DataFrame, applied: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; none if the template is applied as it stands."""
    return template.exceptAll(applied).withColumn("side", F.lit("template")).unionByName(applied.exceptAll(template).withColumn("side", F.lit("applied")))


def reference_ids(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One id per key from two reference feeds: agreed, a conflict, or from one of them."""
    both = a.select(key, value, F.lit(1).alias("_s")).unionByName(b.select(key, value, F.lit(2).alias("_s"))).where(f"{value} IS NOT NULL")
    x = both.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n"), F.countDistinct("_s").alias("_m"))
    return x.select(key, F.when(F.col("_n") == 1, F.col(value)).alias(value), F.when(F.col("_n") > 1, "conflict").when(F.col("_m") == 2, "agreed").otherwise("single").alias("status"))
