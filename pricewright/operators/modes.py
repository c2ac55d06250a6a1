"""Which competitor prices a format competes with: regular offers, percentiles or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FINE, MONEY, coefficient

MODES = ("regular", "percentile", "mixed")


def effective_mode(configured: Column, physical: Column, percentile: Column) -> Column:
    """Percentile configurations make a format mixed beside physical ones, else percentile; without them the configured mode holds."""
    mode = F.when(F.lower(F.trim(configured)).isin(*MODES), F.lower(F.trim(configured))).otherwise("regular")
    return F.when(percentile, F.when(physical, "mixed").otherwise("percentile")).otherwise(mode)


def format_modes(formats: DataFrame, configs: DataFrame, fmt: str = "format", mode: str = "mode", source: str = "source") -> DataFrame:
    """(format, mode) from the formats' configured mode and the kinds of their configured sources."""
    is_pct = F.startswith(F.trim(F.col(source)), F.lit("percentile:"))
    filled = F.trim(F.coalesce(F.col(source), F.lit(""))) != ""
    kinds = configs.groupBy(fmt).agg(F.bool_or(filled & ~is_pct).alias("_phys"), F.bool_or(filled & is_pct).alias("_pct"))
    no = F.lit(False)
    return formats.join(kinds, fmt, "left").select(fmt, effective_mode(F.col(mode), F.coalesce("_phys", no), F.coalesce("_pct", no)).alias("mode"))


def percentile_candidates(values: DataFrame, configs: DataFrame, number: Column | None = None) -> DataFrame:
    """(format, product, source, percentile, original, coefficient, p): percentile values of configured sources, times their coefficient.

    values: (product, source, percentile, value); configs: (format, source, coefficient).
    Values that aren't positive go; a coefficient out of range counts as 1. ``number``: one level only.
    """
    good = values.where(F.col("value") > 0)
    if number is not None:
        good = good.where(F.col("percentile") == number)
    c = F.coalesce(coefficient(F.col("coefficient")), F.lit(1)).cast(FINE)
    x = good.join(configs, "source")
    return x.select("format", "product", "source", "percentile", F.col("value").cast(MONEY).alias("original"), c.alias("coefficient"), (F.col("value").cast(MONEY) * c).cast(MONEY).alias("p"))


def candidates_by_mode(formats: DataFrame, regular: DataFrame, percentile: DataFrame) -> DataFrame:
    """(format, product, source, p): what each format's mode admits, one union and one join with the short list of formats.

    formats: (format, mode, percentile_number); regular: (format, product, source, p);
    percentile: that and ``percentile``. Mixed formats take every level, percentile formats their own.
    """
    both = regular.select("format", "product", "source", "p", F.lit(None).cast("int").alias("percentile")).unionByName(percentile.select("format", "product", "source", "p", "percentile"))
    level = F.coalesce(F.col("percentile_number"), F.lit(10))
    admitted = F.when(F.col("percentile").isNull(), F.col("mode").isin("regular", "mixed")).otherwise((F.col("mode") == "mixed") | ((F.col("mode") == "percentile") & (F.col("percentile") == level)))
    return both.join(formats, "format").where(admitted).select("format", "product", "source", "p")


def zone_references(admitted: DataFrame) -> DataFrame:
    """(format, product, reference): the lowest admitted price, against which the zone is set."""
    return admitted.where(F.col("p") > 0).groupBy("format", "product").agg(F.min("p").alias("reference"))


def gated_percentiles(rows: DataFrame, configs: DataFrame, groups: DataFrame, number: Column) -> DataFrame:
    """Percentile rows that a format may use, with their coefficient.

    rows: (format, region, rival, key, scope, percentile, value, source). A row of a
    multi-price source (key ``emit:`` or an active group) has to be regional; it is
    used if its source is configured, else at the format's own level if its group is active.
    Other rows need a configuration.
    """
    g = groups.select("format", "region", "rival", F.coalesce("key", F.lit("")).alias("key")).distinct()
    exact = g.withColumn("_exact", F.lit(True))
    loose = g.select("format", "region", "rival").distinct().withColumn("_loose", F.lit(True))
    x = rows.withColumn("key", F.coalesce("key", F.lit(""))).join(exact, ["format", "region", "rival", "key"], "left").join(loose, ["format", "region", "rival"], "left")
    x = x.join(configs.select("format", "source", "coefficient", F.lit(True).alias("_set")), ["format", "source"], "left")
    active = F.coalesce(F.col("_exact"), F.lit(False)) | ((F.col("key") == "") & F.coalesce(F.col("_loose"), F.lit(False)))
    is_set = F.coalesce(F.col("_set"), F.lit(False))
    multi = F.col("key").startswith("emit:") | active
    usable = F.when(multi, (F.col("scope") == "regional") & (is_set | ((F.col("percentile") == number) & active))).otherwise(is_set)
    c = F.when(is_set, F.coalesce(coefficient(F.col("coefficient")), F.lit(1))).otherwise(F.lit(1)).cast(FINE)
    return x.where(usable & (F.col("value") > 0)).select("format", "product", F.when(multi & ~is_set, F.concat(F.lit("percentile:"), "region", F.lit(":"), "rival")).otherwise(F.col("source")).alias("source"), "percentile", (F.col("value").cast(MONEY) * c).cast(MONEY).alias("p"))


def memorandum(price: Column, cap: Column, floor: Column, n_caps: Column) -> Column:
    """The price under a cap, and what to say of it: applied, before, below_floor, duplicate, code."""
    on = cap.isNotNull() & (cap > 0)
    after = F.when(on, F.least(price, cap)).otherwise(price)
    changed, below, twice = on & (after < price), on & F.coalesce(cap < floor, F.lit(False)), on & (n_caps > 1)
    code = F.when(below, "memorandum_below_mdc").when(changed, "memorandum_cap").when(twice, "memorandum_duplicate_conflict").otherwise("")
    return F.struct(after.alias("price"), F.coalesce(changed, F.lit(False)).alias("applied"), F.when(changed, price).alias("before"), F.coalesce(below, F.lit(False)).alias("below_floor"), F.coalesce(twice, F.lit(False)).alias("duplicate"), code.alias("code"))


def stock_snapshot(stock: DataFrame, cost: DataFrame, key: str = "product") -> DataFrame:
    """The assortment of a branch: products in stock, with their positive cost if one is known."""
    c = cost.where(f"{key} IS NOT NULL AND cost > 0").groupBy(key).agg(F.max("cost").alias("cost"))
    return stock.where(f"{key} IS NOT NULL").select(key).distinct().join(c, key, "left")


def reconciliation(stock: DataFrame, snapshot: DataFrame, key: str = "product") -> DataFrame:
    """One row: stock rows, duplicates among them, products, with and without cost."""
    s = stock.agg(F.count("*").alias("stock_rows"), F.count_if(F.col(key).isNull()).alias("unknown"), F.countDistinct(key).alias("products"))
    c = snapshot.agg(F.count("cost").alias("with_cost"))
    return s.join(F.broadcast(c), how="cross").select("stock_rows", "unknown", "products", (F.col("stock_rows") - F.col("unknown") - F.col("products")).alias("duplicates"), "with_cost", (F.col("products") - F.col("with_cost")).alias("without_cost"))  # one row each


def not_in_stock(priced: DataFrame, snapshot: DataFrame, key: str = "product") -> DataFrame:
    """Priced rows whose product is no longer in the assortment."""
    return priced.join(snapshot.select(key), key, "left_anti")
