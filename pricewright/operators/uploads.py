"""What imports do to tables: upserts, whole snapshots, learned links, copies of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import external_sku
from ..functions.values import positive_whole
from .dedup import best_per_key


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The table after the import, with ``change``: inserted, updated, unchanged or untouched.

    Of incoming rows with one key the first by ``order`` counts, which for files is
    the last row. Rows whose key is null are left out. One full join on the keys.
    """
    rest = [c for c in existing.columns if c not in keys]
    good = incoming.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    new = best_per_key(good, keys, *order).select(*keys, F.struct(*rest).alias("_n"))
    x = existing.select(*keys, F.struct(*rest).alias("_o")).join(new, keys, "full")
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "untouched").when(F.col("_n") == F.col("_o"), "unchanged").otherwise("updated")
    return x.select(*keys, *[F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col("_o")[c]).alias(c) for c in rest], change.alias("change"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Existing rows as they are, and of new keys the first row by ``order``."""
    new = best_per_key(incoming, keys, *order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def replace_snapshots(existing: DataFrame, incoming: DataFrame, scope: str, bad: Column) -> DataFrame:
    """Scopes with incoming rows are replaced as a whole; where one of the rows is bad the former snapshot stays.

    Written with dynamic partition overwrite by ``scope`` this touches the replaced scopes' files alone.
    """
    verdict = incoming.groupBy(scope).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("_bad"))
    good = verdict.where("NOT _bad").select(scope)
    kept = existing.join(good, scope, "left_anti")
    return kept.unionByName(incoming.join(good, scope, "left_semi").select(*existing.columns))


def ratings(rows: DataFrame, position: str) -> DataFrame:
    """(sku, rank): positive whole ranks; of rows with one SKU the first in the file counts."""
    x = rows.select(F.nullif(external_sku(F.col("sku")), F.lit("")).alias("sku"), positive_whole(F.col("rank")).alias("rank"), position)
    return best_per_key(x.where("sku IS NOT NULL AND rank IS NOT NULL"), ["sku"], F.asc(position)).select("sku", "rank")


def manual_list(rows: DataFrame, position: str) -> DataFrame:
    """(sku, price): positive prices; of rows with one SKU the last in the file counts."""
    x = rows.select(F.nullif(external_sku(F.col("sku")), F.lit("")).alias("sku"), numbers.price(F.col("price")).alias("price"), position)
    return best_per_key(x.where("sku IS NOT NULL AND price IS NOT NULL"), ["sku"], F.desc(position)).select("sku", "price")


def copy_rules(rules: DataFrame, rows: DataFrame, rule: str, code: Column) -> DataFrame:
    """Rows of the templates under a new code per rule; a code that is taken is an error."""
    named = rules.select(rule, code.alias("_code"))
    taken = named.join(rules.select(F.col("code").alias("_code")), "_code", "left_semi")
    if not taken.isEmpty():
        raise ValueError("a new rule's code is taken")
    return rows.join(named, rule).withColumnRenamed("_code", "code")
