"""Price lists and their items: which are usable, which are assigned, and the price rows they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, identity
from ..functions.text import external_sku, labelled_keys, sku_variants

# States of a refresh after which a list isn't used; branches whose own ids are reference SKUs.
UNUSABLE = ("failed", "error", "stale")
REFERENCE_BRANCHES = (128, 133)


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def priced_and_known(price: Column, *ids: Column) -> Column:
    """A price above 0 and at least one identifier."""
    known = F.lit(False)
    for c in ids:
        known = known | filled(c)
    return F.coalesce(price > 0, F.lit(False)) & known


def usable(source_key: Column, source_type: Column, name: Column, status: Column, *texts: Column) -> Column:
    """A list of one price per product, with a competitor's identity, whose last refresh didn't fail."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    multi = low(source_key).startswith("emit:") | (low(source_type) == "emit") | (identity.percentile_mode(source_type, F.lit(None), *texts) == "multi_price")
    return ~F.coalesce(multi, F.lit(False)) & filled(name) & ~low(status).isin(*UNUSABLE)


def assigned(lists: DataFrame, assignments: DataFrame, active_only: bool = True, list_id: str = "list_id") -> DataFrame:
    """Lists beside their assignments, with ``place``: the newest update first, then the larger id, within each format."""
    a = assignments.where("is_active") if active_only else assignments
    newest = Window.partitionBy("format_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col(list_id).desc())
    return a.join(lists, list_id).withColumn("place", F.row_number().over(newest))


def price_rows(prices: DataFrame, items: DataFrame, lists: DataFrame) -> DataFrame:
    """``prices`` (format_id, product, source, price, coefficient) in which the rows of all given lists are built anew from their matched items.

    Rows without a product (settings of a source) stay. An item counts if it has a product, a matched SKU and a price.
    """
    named = lists.select("list_id", "format_id", "source", "coefficient")
    kept = prices.join(named.select("format_id", "source", F.lit(True).alias("_new")).distinct(), ["format_id", "source"], "left").where(F.col("_new").isNull() | F.col("product").isNull())
    new = items.where(F.col("product").isNotNull() & filled(F.col("matched_sku")) & F.col("price").isNotNull()).join(named, "list_id")
    cols = ["format_id", "product", "source", "price", "coefficient"]
    return kept.select(cols).unionByName(new.select(cols))


def feed_prices(feed: DataFrame, products: DataFrame) -> DataFrame:
    """(row, sku, product, price, outcome): feed rows whose id is, in one of its spellings, a product's; the first spelling that is one decides.

    The discounted price if it is above 0, else the list price; of products that share a spelling the largest id stands.
    ``outcome``: priced, no_price, no_product or no_sku.
    """
    known = products.select(F.explode(sku_variants(F.col("sku"))).alias("k"), "product").groupBy("k").agg(F.max("product").alias("product"))
    ids = feed.select("row", F.posexplode(sku_variants(F.col("sku"))).alias("i", "k")).join(known, "k")
    found = ids.groupBy("row").agg(F.min_by("product", "i").alias("product"))
    price = F.when(F.col("discounted") > 0, F.col("discounted")).when(F.col("listed") > 0, F.col("listed"))
    outcome = F.when(external_sku(F.col("sku")) == "", "no_sku").when(F.col("product").isNull(), "no_product").when(F.col("price").isNull(), "no_price").otherwise("priced")
    return feed.join(found, "row", "left").withColumn("price", F.when(F.col("product").isNotNull(), price)).select("row", "sku", "product", "price", outcome.alias("outcome"))


def feed_totals(found: DataFrame) -> DataFrame:
    """(rows, matched, priced, missing): counts of a feed's rows, and of distinct ids without a product."""
    ids = F.when(F.col("outcome") != "no_sku", external_sku(F.col("sku")))
    return found.agg(
        F.count("*").alias("rows"), F.count("product").alias("matched"), F.count("price").alias("priced"),
        (F.countDistinct(ids) - F.countDistinct(F.when(F.col("product").isNotNull(), ids))).alias("missing"),
    )


def supplier_keys(goods: Column, own: Column, expiry: Column, branch: Column) -> Column:
    """array<struct<kind, key>>: exact keys of a supplier's item: the goods id, on reference branches its own id in all spellings, and both with each other or a date."""
    g, o = F.nullif(external_sku(goods), F.lit("")), F.nullif(external_sku(own), F.lit(""))
    key = lambda kind, c: F.concat(F.lit(f"provisor:{kind}:"), c)
    one = labelled_keys(("goods_id", key("goods_id", g)), ("goods_distributor_composite", key("goods_distributor_composite", F.concat_ws("_", g, o))), ("goods_id_shelf_life", key("goods_id_shelf_life", F.concat(g, F.lit("_"), F.coalesce(F.nullif(dates.expiry(expiry), F.lit("")), F.lit("no_exp"))))))
    one = F.filter(one, lambda x: (x["kind"] != "goods_distributor_composite") | (g.isNotNull() & o.isNotNull()))
    one = F.filter(one, lambda x: (x["kind"] != "goods_id_shelf_life") | filled(expiry))
    mine = F.when(branch.isin(*REFERENCE_BRANCHES) & o.isNotNull(), F.transform(sku_variants(own), lambda v: F.struct(F.lit("reference_sku").alias("kind"), key("reference_sku", v).alias("key"))))
    return F.concat(one, F.coalesce(mine, F.array().cast("array<struct<kind:string,key:string>>")))


def telling(c: Column) -> Column:
    """A coefficient that says something: above 0 and not 1."""
    return F.coalesce((c > 0) & (c != 1), F.lit(False))


def backfill_coefficients(lists: DataFrame, assignments: DataFrame) -> DataFrame:
    """``lists`` whose ``price_coefficient``, where it is null or 1, is filled from the list's own older ``coefficient``, else from its newest active assignment (by date, then id) that has one."""
    newest = assignments.where(F.col("is_active") & telling(F.col("coefficient"))).groupBy("list_id").agg(F.max_by("coefficient", F.struct("updated_at", "id")).alias("_given"))
    own = F.when(telling(F.col("coefficient")), F.col("coefficient"))
    blank = F.col("price_coefficient").isNull() | (F.col("price_coefficient") == 1)
    return lists.join(newest, "list_id", "left").withColumn("price_coefficient", F.when(blank, F.coalesce(own, F.col("_given"), F.col("price_coefficient"))).otherwise(F.col("price_coefficient"))).drop("_given")


#: Outcomes of a check after which a list counts as read.
READ = ("checked_unchanged", "updated", "success_zero_items")


def mark_checked(lists: DataFrame, checks: DataFrame) -> DataFrame:
    """``lists`` after checks of their sources; items aren't touched.

    Lists have list_id, source_type, source_key, account, external_id, source_updated_at, updated_at, checked_at, success_at, status, message; checks the like. A check's list is the newest of its type
    and key; a provisor's with an account may also be the one last read under the same account and external id, whose key then changes. Of several checks of one list the last counts.
    """
    numbered = checks.withColumn("_check", F.monotonically_increasing_id())
    by_key = lists.groupBy("source_type", "source_key").agg(F.max_by("list_id", F.struct("updated_at", "list_id")).alias("_a"))
    place = F.struct(F.coalesce("success_at", F.lit("0001-01-01").cast("timestamp")), "updated_at", "list_id")
    by_account = lists.where("source_type = 'provisor' AND trim(account) <> '' AND trim(external_id) <> ''").groupBy(F.trim("account").alias("account"), F.trim("external_id").alias("external_id")).agg(F.max_by("list_id", place).alias("_b"))
    found = numbered.join(by_key, ["source_type", "source_key"], "left").withColumns({"account": F.trim("account"), "external_id": F.trim("external_id")}).join(by_account, ["account", "external_id"], "left")
    found = found.withColumn("list_id", F.coalesce("_a", F.when(F.col("source_type") == "provisor", F.col("_b")))).where("list_id IS NOT NULL")
    last = found.groupBy("list_id").agg(F.max_by(F.struct("source_key", "source_updated_at", "checked_at", "status", "message"), F.struct("checked_at", "_check")).alias("c"))
    x = lists.join(last, "list_id", "left")
    seen = F.col("c").isNotNull()
    new = {
        "source_key": F.col("c.source_key"), "source_updated_at": F.coalesce(F.nullif(F.col("c.source_updated_at"), F.lit("")), F.col("source_updated_at")), "checked_at": F.col("c.checked_at"),
        "success_at": F.when(F.col("c.status").isin(*READ), F.col("c.checked_at")).otherwise(F.col("success_at")), "status": F.col("c.status"), "message": F.left(F.coalesce("c.message", F.lit("")), F.lit(512)),
    }
    return x.withColumns({k: F.when(seen, v).otherwise(F.col(k)) for k, v in new.items()}).drop("c")


def percentile_settings(settings: DataFrame, chosen: DataFrame, formats: DataFrame) -> DataFrame:
    """``settings`` (format_id, product, source, supplier, coefficient) in which the percentile sources of ``formats`` are exactly the chosen ones.

    ``chosen``: format_id, id, name, coefficient (text), enabled; a bad coefficient is 1. Prices and other sources' settings stay.
    """
    cols = ["format_id", "product", "source", "supplier", "coefficient"]
    old = F.col("product").isNull() & F.col("source").startswith("percentile:")
    kept = settings.where(~old).unionByName(settings.where(old).join(formats.select("format_id").distinct(), "format_id", "left_anti").select(settings.columns))
    x = chosen.where("coalesce(enabled, true)").select("format_id", F.concat(F.lit("percentile:"), F.trim("id")).alias("source"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.col("coefficient").try_cast("double").alias("c")).where("source <> 'percentile:'")
    x = x.join(formats.select("format_id").distinct(), "format_id", "left_semi").groupBy("format_id", "source").agg(F.max("name").alias("name"), F.max("c").alias("c"))
    new = x.select("format_id", F.lit(None).cast(settings.schema["product"].dataType).alias("product"), "source", F.coalesce("name", "source").alias("supplier"), F.coalesce(F.nullif(F.col("c"), F.lit(0.0)), F.lit(1.0)).alias("coefficient"))
    return kept.select(cols).unionByName(new.select(cols))
