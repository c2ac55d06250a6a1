"""Exact interpolated percentiles of prices, by group and of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (10, 20, 30, 40, 60)


def _levels(levels: tuple[int, ...]):
    return F.array(*[F.lit(p / 100) for p in levels])


def percentiles(prices: DataFrame, keys: list[str], price: str, source: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(keys, percentile, value, n_prices, n_sources) over positive prices; linear interpolation, as PERCENTILE.INC.

    One shuffle: equal prices and sources of a group combine before it, and a group
    has no more sources than there are suppliers (a distinct count would deal the rows out twice).
    """
    good = prices.where(F.col(price) > 0)
    out = good.groupBy(*keys).agg(F.percentile(price, _levels(levels)).alias("v"), F.count("*").alias("n_prices"), F.size(F.collect_set(source)).cast("bigint").alias("n_sources"))
    return out.select(*keys, "n_prices", "n_sources", F.posexplode("v").alias("i", "value")).withColumn("percentile", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1)).drop("i")


def percentile_of_percentiles(values: DataFrame, keys: list[str], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """For each level p, the p-th percentile of the given groups' p-values: one aggregation with a filter per level."""
    aggs = [F.percentile(F.when(F.col("percentile") == p, F.col("value")), p / 100).alias(f"p{p}") for p in levels]
    n = F.count(F.when(F.col("percentile") == levels[0], F.col("value"))).alias("n_groups")
    wide = values.groupBy(*keys).agg(*aggs, n)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("value")) for p in levels]))
    return wide.select(*keys, "n_groups", pairs.alias("x")).select(*keys, "n_groups", "x.percentile", "x.value")


def regular_percentiles(prices: DataFrame, keys: list[str], price: str, source: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Percentiles with the count and ends of the sample."""
    good = prices.where(F.col(price) > 0)
    out = good.groupBy(*keys).agg(F.percentile(price, _levels(levels)).alias("v"), F.count("*").alias("sample_count"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.size(F.collect_set(source)).cast("bigint").alias("source_count"))
    return out.select(*keys, "sample_count", "min_price", "max_price", "source_count", F.posexplode("v").alias("i", "value")).withColumn("percentile", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1)).drop("i")


def status(n):
    return F.when(n == 0, "No data").when(n == 1, "One price").otherwise("Calculated")


def densify(values: DataFrame, groups: DataFrame, products: DataFrame, keys: list[str], product: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """A row for each group, product and level, with null values where there are none.

    The result itself is that product; groups are regions or competitors, a
    table of known size beside the products.
    """
    grid = products.select(product).withColumn("percentile", F.explode(F.array(*map(F.lit, levels)))).join(F.broadcast(groups.select(*keys)), how="cross")
    out = grid.join(values, [*keys, product, "percentile"], "left")
    return out.withColumn("n_prices", F.coalesce("n_prices", F.lit(0))).withColumn("status", status(F.col("n_prices")))


def fan_out(values: DataFrame, formats: DataFrame) -> DataFrame:
    """The same rows for every price format of a short list."""
    return values.join(F.broadcast(formats), how="cross")
