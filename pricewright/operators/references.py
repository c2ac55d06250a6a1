"""Several reference files in one call: stock, cost, ratings and names by branch, each judged for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import external_sku
from ..functions.values import positive_whole
from .dedup import best_per_key

# Types of files; what their sheets must have; how rows fail.
SNAPSHOTS = ("stock", "cost")
RATINGS = ("rating_global", "rating_local")
NAMED = ("holdings", "counterparties", "delivery_points")
REQUIRED = {"stock": ("sku", "stock"), "cost": ("sku", "cost"), "rating_global": ("sku", "rank"), "rating_local": ("sku", "rank"), "products": ("sku",), "holdings": ("name",), "counterparties": ("name",), "delivery_points": ("name",)}
EMPTY_SKU, EMPTY_NAME, BAD_RANK, REPEATED, UNKNOWN = "empty SKU", "empty name", "bad rank", "repeated SKU", "unknown SKU"


def lacking(data_type: Column, headers: Column) -> Column:
    """Columns that a file of this type must have and has not; null for an unknown type."""
    need = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in REQUIRED.items() for v in kv])
    return F.array_except(need[data_type], headers)


def judged(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` (file, data_type, row, sku, value, name) with ``fault``: null, or why the row doesn't count.

    Ratings are positive whole numbers of known products, and of rows with one SKU the first counts; other files bring
    their products along, so any SKU is good.
    """
    kind, sku = F.col("data_type"), external_sku(F.col("sku"))
    first = rows.where(kind.isin(*RATINGS) & (sku != "") & positive_whole(F.col("value")).isNotNull()).groupBy("file", sku.alias("_sku")).agg(F.min("row").alias("_first"))
    known = products.select(external_sku(F.col("sku")).alias("_sku")).distinct().withColumn("_known", F.lit(True))
    x = rows.withColumn("_sku", sku).join(known, "_sku", "left").join(first, ["file", "_sku"], "left")
    fault = (
        F.when(kind.isin(*NAMED), F.when(F.trim(F.coalesce("name", F.lit(""))) == "", EMPTY_NAME))
        .when(F.col("_sku") == "", EMPTY_SKU)
        .when(kind.isin(*RATINGS), F.when(positive_whole(F.col("value")).isNull(), BAD_RANK).when(F.col("_first") < F.col("row"), REPEATED).when(F.col("_known").isNull(), UNKNOWN))
    )
    return x.withColumn("fault", fault).withColumn("sku", F.col("_sku")).drop("_sku", "_known", "_first")


def jobs(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, data_type, total, good, failed, status, error): a row per file, also of files without rows.

    ``files``: file, data_type, headers. A file that lacks a column is an error as a whole; one with a bad row is partial; else it is a success.
    """
    n = rows.groupBy("file").agg(F.count("*").alias("total"), F.count("fault").alias("failed"))
    x = files.join(n, "file", "left").na.fill(0, ["total", "failed"]).withColumn("_lacks", lacking(F.col("data_type"), F.col("headers")))
    error = F.when(F.col("_lacks").isNull(), "unknown type").when(F.size("_lacks") > 0, F.concat(F.lit("missing columns: "), F.array_join("_lacks", ", ")))
    x = x.withColumn("error", error)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("failed") > 0, "partial").otherwise("success")
    bad = F.col("error").isNotNull()
    return x.select("file", "data_type", F.when(bad, 0).otherwise(F.col("total")).alias("total"), F.when(bad, 0).otherwise(F.col("total") - F.col("failed")).alias("good"), F.when(bad, 0).otherwise(F.col("failed")).alias("failed"), status.alias("status"), "error")


def batch_status(done: DataFrame) -> DataFrame:
    """One row: the worst status of any file, and how many files have which."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    status = F.when(n("error") > 0, "error").when(n("partial") > 0, "partial").otherwise("success")
    return done.agg(status.alias("status"), F.count("*").alias("jobs"), n("success").alias("succeeded"), n("partial").alias("partly"), n("error").alias("failed"))


def applied(existing: DataFrame, rows: DataFrame, done: DataFrame, branches: DataFrame) -> DataFrame:
    """``existing`` (data_type, branch, sku, value) after the batch.

    ``branches`` (file, branch): those a file was sent for. A stock or cost file that succeeded replaces each of its branches as a whole, those too that
    it has no row for; one with a bad row changes nothing. Of several files for one branch and type the last counts. Ratings are put in by SKU, good rows of partial files
    too, the last file standing. Of rows of one file with one SKU the last counts.
    """
    cols = ["data_type", "branch", "sku", "value"]
    sent = branches.join(done.where("status <> 'error'").select("file", "data_type", "status"), "file")
    whole = sent.where(F.col("data_type").isin(*SNAPSHOTS) & (F.col("status") == "success")).groupBy("data_type", "branch").agg(F.max("file").alias("file"))
    good = rows.where("fault IS NULL").drop("data_type")
    new = best_per_key(good.join(whole, "file"), ["data_type", "branch", "sku"], F.desc("row")).select(cols)
    rated = good.join(sent.where(F.col("data_type").isin(*RATINGS)), "file")
    rated = best_per_key(rated, ["data_type", "branch", "sku"], F.desc("file"), F.desc("row")).select(cols)
    kept = existing.select(cols).join(whole, ["data_type", "branch"], "left_anti").join(rated, ["data_type", "branch", "sku"], "left_anti")
    return kept.unionByName(new).unionByName(rated)
