"""Reports and audits over feeds, runs, percentiles and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import best_per_key


def scoped(rows: DataFrame, wanted: DataFrame, key: str, fallback: str) -> DataFrame:
    """Rows in scope by their key or, where the key is empty, by the fallback: two semi joins, no OR."""
    w = wanted.select(F.col(key).alias("_k"), F.col(fallback).alias("_f"))
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    a = rows.where(~empty).join(w.where("_k <> ''"), F.col(key) == F.col("_k"), "left_semi")
    return a.unionByName(rows.where(empty).join(w, F.col(fallback) == F.col("_f"), "left_semi"))


def item_counts(lists: DataFrame, items: DataFrame, key: str, counted: Column, *aggs: Column) -> DataFrame:
    """Every list with its number of items and of those that count, zero for lists without any."""
    n = items.groupBy(key).agg(F.count("*").alias("items"), F.count_if(counted).alias("counted"), *aggs)
    return lists.join(n, key, "left").withColumns({"items": F.coalesce("items", F.lit(0)), "counted": F.coalesce("counted", F.lit(0))})


def hidden_reason(items: Column, status: Column, active: Column) -> Column:
    """Why a list isn't shown: empty, failed or unassigned; null if it is."""
    return F.when(items == 0, F.when(F.lower(status).isin("failed", "error"), "failed_empty").otherwise("empty")).when(~F.coalesce(active, F.lit(False)), "not_assigned")


def percentile_groups(rows: DataFrame, keys: list[str], product: str, count: str, updated: str) -> DataFrame:
    """Groups of percentile rows: products, prices behind them, latest update."""
    return rows.groupBy(*keys).agg(F.countDistinct(product).alias("skus"), F.sum(count).alias("prices"), F.max(updated).alias("updated"))


def browser(rows: DataFrame, product: str, levels: tuple[int, ...]) -> DataFrame:
    """A row per product with a column per level; where several sources have a level, that percentile of theirs."""
    aggs = [F.percentile(F.when(F.col("percentile") == p, F.col("value")), p / 100).alias(f"p{p}") for p in levels]
    return rows.where(F.col("percentile").isin(*levels) & F.col("value").isNotNull()).groupBy(product).agg(*aggs, F.countDistinct("source").alias("sources"))


def coverage_funnel(products: DataFrame, prices: DataFrame, stored: DataFrame, product: str) -> DataFrame:
    """One row: products, those with a price, with a positive one, with a stored percentile, and positive ones without."""
    flags = prices.groupBy(product).agg(F.bool_or(F.col("price") > 0).alias("_pos")).withColumn("_any", F.lit(True))
    x = products.select(product).join(flags, product, "left").join(stored.select(product, F.lit(True).alias("_st")).distinct(), product, "left")
    no = F.lit(False)
    pos, st = F.coalesce("_pos", no), F.coalesce("_st", no)
    return x.agg(F.count("*").alias("products"), F.count("_any").alias("priced"), F.count_if(pos).alias("positive"), F.count_if(st).alias("stored"), F.count_if(pos & ~st).alias("lost"))


def trace(prices: DataFrame, where: Column, keys: list[str], most: int = 1000) -> DataFrame:
    """The raw prices behind one percentile value, ascending, ``most`` at most: it is a report."""
    return prices.where(where & (F.col("price") > 0)).select(*keys, "source", "price").orderBy("price", "source").limit(most)


def region_verdict(city: Column, region: Column, filial: Column, texts: Column, wanted: Column, wanted_filials: Column) -> Column:
    """match, mismatch or unknown: by the structured city or region, then by the filial, then by address and name."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    w, c, r = norm(wanted), norm(city), norm(region)
    stated = (c != "") | (r != "")
    return (
        F.when(stated, F.when((c == w) | (r == w), "match").otherwise("mismatch"))
        .when(filial.isNotNull(), F.when(F.array_contains(wanted_filials, filial), "match").otherwise("mismatch"))
        .when(norm(texts) != "", F.when(F.contains(norm(texts), w), "match").otherwise("unknown")).otherwise("unknown")
    )


def outcomes(rows: DataFrame, key: str, outcome: str, planned: tuple[str, ...]) -> DataFrame:
    """Rows per key by outcome, their total, and whether each has one of the planned outcomes."""
    known = F.col(outcome).isin(*planned)
    return rows.groupBy(key).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in planned], F.count("*").alias("total"), (F.count_if(known) == F.count("*")).alias("accounted"))


def slowest(runs: DataFrame, key: str, seconds: str, most: int = 10) -> DataFrame:
    return runs.groupBy(key).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("runs")).orderBy(F.desc("seconds"), key).limit(most)


def readiness(context: DataFrame, as_of: Column, max_days: int) -> DataFrame:
    """What each context lacks: (key, products, costs, updated) to a state and the days since the update."""
    age = F.greatest(F.datediff(as_of, F.col("updated")), F.lit(0))
    state = F.when(F.coalesce(F.col("products"), F.lit(0)) == 0, "no_products").when(F.coalesce(F.col("costs"), F.lit(0)) == 0, "no_costs").when(F.col("updated").isNull() | (age > max_days), "stale").otherwise("ready")
    return context.withColumn("days", age).withColumn("state", state)


def latest_selection(rows: DataFrame, keys: list[str], row: str, updated: str) -> DataFrame:
    """(row, selected, coefficient): a selection moves to the duplicate with the newest source date, with its coefficient."""
    w = Window.partitionBy(*keys)
    newest = F.max_by(row, F.struct(updated, row)).over(w)
    chosen = F.bool_or("selected").over(w)
    coefficient = F.max_by("coefficient", F.when(F.col("selected"), F.struct(updated, row))).over(w)
    return rows.select(row, (chosen & (F.col(row) == newest)).alias("selected"), F.when(chosen & (F.col(row) == newest), coefficient).alias("coefficient"))


def ratings(rows: DataFrame, product: str, branch: Column) -> DataFrame:
    """(product, global_rating, local_rating): the latest rating without a branch and that of the branch."""
    scope = F.when(F.col("branch").isNull(), "global").when(F.col("branch") == branch, "local")
    good = rows.where(F.col("rating").isNotNull()).withColumn("_scope", scope).where("_scope IS NOT NULL")
    newest = F.struct("updated", "id")
    return good.groupBy(product).agg(*[F.max_by("rating", F.when(F.col("_scope") == s, newest)).alias(f"{s}_rating") for s in ("global", "local")])


def recent(runs: DataFrame, updated: str, row: str, most: int = 30) -> DataFrame:
    return runs.orderBy(F.desc(updated), F.desc(row)).limit(most)


def merged_aliases(rows: DataFrame, keys: list[str], alias: str, order: str) -> DataFrame:
    """The different aliases of each key, in order of first appearance."""
    first = rows.where(F.col(alias).isNotNull()).groupBy(*keys, alias).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", alias))), lambda x: x[alias]).alias("aliases"))


def prices_by_column(prices: DataFrame, columns: DataFrame, product: str) -> DataFrame:
    """(product, title, price): the best price per product and report column, times the source's coefficient."""
    c = F.coalesce(F.col("coefficient"), F.lit(1.0))
    x = prices.where(F.col("price") > 0).join(F.broadcast(columns), "source")  # a report has a few dozen columns
    return x.groupBy(product, "title").agg(F.min(F.col("price") * c).alias("price"))


def baseline_price(cands: Column, floor: Column, bend: Column, fallback: Column) -> Column:
    """The price that the ordered search gives for another floor: the first bent candidate that reaches it, else the floor."""
    from .ranges import as_of

    bent = F.transform(cands, lambda p: p * (1 - as_of(bend, p, fallback) / 100))
    return F.coalesce(F.get(F.filter(bent, lambda p: p >= floor), F.lit(0)), floor)


def contractors(links: DataFrame, formats: DataFrame, holdings: DataFrame, parties: DataFrame, points: DataFrame, most: int = 300) -> DataFrame:
    """Formats with their contractors; formats alone where nothing is linked. A page of ``most``."""
    x = links.join(formats, "format_id").join(holdings, "holding_id", "left").join(parties, "party_id", "left").join(points, "point_id", "left")
    if x.isEmpty():
        x = formats.select("*", *[F.lit(None).cast("string").alias(c) for c in ("holding", "party", "point")])
    return x.select("format_id", "format", "holding", "party", "point").orderBy("format_id", "holding", "party", "point").limit(most)


def diagnostics(feeds: DataFrame, items: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Each feed with its items, whether it is assigned, and what that means."""
    x = item_counts(feeds, items, key, F.col("product").isNotNull()).join(assignments.groupBy(key).agg(F.bool_or("is_active").alias("_a")), key, "left")
    verdict = F.when(F.col("items") == 0, "no_items").when(F.col("_a").isNull(), "no_assignment").when(~F.col("_a"), "inactive").when(F.col("counted") == 0, "nothing_matched").otherwise("in_use")
    return x.select(key, "items", "counted", verdict.alias("verdict"))


def inventory(feeds: DataFrame, key: str, order: Column) -> DataFrame:
    """One row: planned feeds, repeated ones, and how many are fetched once."""
    n = feeds.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("planned"), F.sum(F.col("n") - 1).alias("duplicates"), F.count("*").alias("selected"))


def import_summary(rows: DataFrame, key: str, found: Column, invalid: Column, empty: Column) -> DataFrame:
    """One row of an import's counters; later rows of a key are duplicates."""
    good = ~empty & ~invalid & found
    x = rows.select(empty.alias("e"), invalid.alias("i"), found.alias("f"), good.alias("g"), F.when(good, F.col(key)).alias("k"))
    return x.agg(
        F.count("*").alias("total_rows"), F.count_if("e").alias("empty_rows"), F.count_if(~F.col("e") & F.col("i")).alias("invalid_rows"), F.count_if(~F.col("e") & ~F.col("i") & ~F.col("f")).alias("not_found"),
        F.countDistinct("k").alias("processed"), (F.count_if("g") - F.countDistinct("k")).alias("duplicates"),
    )


def latest_run_rows(rows: DataFrame, scope: str, run: str, created: str) -> DataFrame:
    """The rows of the newest run of each scope."""
    newest = best_per_key(rows.select(scope, run, created).distinct(), [scope], F.desc(created), F.desc(run)).select(scope, run)
    return rows.join(newest, [scope, run], "left_semi")
