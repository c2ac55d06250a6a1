"""Price lists that a portal shows as web pages: the directory of lists and the rows of one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.makers import with_maker
from ..functions.text import strip_tags
from .feeds import html_cells, html_rows

# Words by which a header is known, in order of preference; words of prices that aren't the price;
# columns of tables without known headers.
HEADERS = {
    "name": ("наименование", "товар", "название"), "manufacturer": ("производитель",), "expiry": ("срок",), "price": ("цена с ндс", "цена, тг", "цена тг", "цена"),
    "pack": ("кол. в уп", "кол", "уп"), "min_order": ("мин. заказ", "миним"), "stock": ("остаток",),
}
OTHER_PRICES = ("стара", "скид", "розн", "old", "discount")
PLACES = {"name": 1, "manufacturer": 2, "expiry": 3, "price": 4, "pack": 5, "min_order": 6, "stock": 7}
REQUIRED = ("name", "manufacturer", "price", "stock")


def shown_number(c: Column) -> Column:
    """A number as a page shows it: spaces and currency signs dropped, a comma is a point; null unless what is left is one."""
    digits = F.regexp_replace(F.translate(c, ",", "."), r"[^0-9.\-]", "")
    return digits.try_cast("decimal(18,4)")


def price_directory(pages: DataFrame, html: str = "html", order: str = "page") -> DataFrame:
    """(id, name, enabled, counterpart, updated_at, phone, city): a row per list that a table row of any page links to.

    Of rows with one id the first stands, by page and place. ``enabled`` by the eye sign, null without one; a list
    without a name is called after its id.
    """
    x = pages.select(order, F.posexplode(html_rows(F.col(html))).alias("at", "row"))
    link = r"(?is)<a\b[^>]*href\s*=\s*['\"]?[^'\">\s]*price/see/(\d+)['\"]?[^>]*>(.*?)</a>"
    supplier = F.regexp_extract("row", r"(?is)<span\b[^>]*id\s*=\s*['\"]supplier_name_[^'\"]+['\"][^>]*>(.*?)</span>", 1)
    known = F.col("row").rlike(r"(?is)<span\b[^>]*id\s*=\s*['\"]supplier_name_[^'\"]+['\"][^>]*>(.*?)</span>")
    x = x.withColumn("id", F.regexp_extract("row", link, 1).try_cast("bigint")).where("id IS NOT NULL").withColumn("cells", html_cells(F.col("row")))
    name = F.nullif(strip_tags(F.when(known, supplier).otherwise(F.regexp_extract("row", link, 2))), F.lit(""))
    cell = lambda i: F.coalesce(strip_tags(F.get("cells", F.lit(i))), F.lit(""))
    found = F.struct(
        F.coalesce(name, F.concat(F.lit("Widman "), "id")).alias("name"),
        F.when(F.contains("row", F.lit("glyphicon-eye-open")), True).when(F.contains("row", F.lit("glyphicon-eye-close")), False).alias("enabled"),
        F.regexp_extract("row", r"(?i)<td\b[^>]*\btitle\s*=\s*['\"]?([^'\"\s>]+)", 1).alias("counterpart"),
        cell(1).alias("updated_at"), cell(6).alias("phone"), cell(7).alias("city"),
    )
    return x.groupBy("id").agg(F.min_by(found, F.struct(order, "at")).alias("f")).select("id", "f.*")


def last_page(html: Column) -> Column:
    """The largest page number that a page tells of, in any of the ways that portals write it; 1 if none."""
    calls = (r"paginationSet\((\d+)\)", r"(?i)\bpageCurrent\s*[:=]\s*['\"]?(\d+)", r"(?i)\bdata-page\s*=\s*['\"]?(\d+)", r"(?i)id\s*=\s*[\"']pageCurrent[\"'][^>]*value\s*=\s*[\"'](\d+)")
    bars = F.regexp_extract_all(html, F.lit(r"(?is)<(ul|div|nav)\b[^>]*(?:pagination|pager)[^>]*>(.*?)</(?:ul|div|nav)>"), F.lit(2))
    shown = F.flatten(F.transform(bars, lambda b: F.regexp_extract_all(b, F.lit(r">\s*(\d{1,4})\s*(?=<)"), F.lit(1))))
    numbers = F.concat(shown, *[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in calls])
    return F.greatest(F.lit(1), F.array_max(F.transform(numbers, lambda n: n.try_cast("int"))))


def _place(heads: Column, words: tuple[str, ...], barred: tuple[str, ...] = ()) -> Column:
    """The first header that holds the first of these words that any holds; from 0, null if none."""
    fits = lambda w: F.transform(heads, lambda h: F.contains(h, F.lit(w)) & ~reduce(lambda a, b: a | b, [F.contains(h, F.lit(x)) for x in barred], F.lit(False)))
    return F.coalesce(*[F.nullif(F.array_position(fits(w), True), F.lit(0)) for w in words]) - 1


def price_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' columns (without the html) and row_no, name, manufacturer, expiry, price, pack, min_order, stock, price_header, missing.

    The first table row is the header; columns are found by words in it, in a table of eight columns or more with neither a name
    nor a price by place. Rows without name and price are left out. ``missing``: required columns that weren't found.
    """
    rest = [c for c in pages.columns if c != html]
    x = pages.select(*rest, html_rows(F.col(html)).alias("_rows")).withColumn("_heads", F.transform(html_cells(F.get("_rows", F.lit(0))), lambda c: F.lower(strip_tags(c))))
    at = {k: _place(F.col("_heads"), words, OTHER_PRICES if k == "price" else ()) for k, words in HEADERS.items()}
    x = x.withColumn("_at", F.struct(*[c.cast("int").alias(k) for k, c in at.items()]))
    blind = (F.size("_heads") >= 8) & F.col("_at.name").isNull() & F.col("_at.price").isNull()
    lacking = F.filter(F.array(*[F.when(F.col(f"_at.{k}").isNull(), F.lit(k)) for k in REQUIRED]), lambda k: k.isNotNull())
    x = x.withColumn("missing", lacking).withColumn("_at", F.when(blind, F.struct(*[F.lit(i).alias(k) for k, i in PLACES.items()])).otherwise(F.col("_at")))
    x = x.select(*rest, "_heads", "_at", "missing", F.posexplode("_rows").alias("row_no", "_row")).where("row_no > 0").withColumn("_cells", F.transform(html_cells(F.col("_row")), strip_tags))
    text = lambda k: F.coalesce(F.when(F.col(f"_at.{k}") >= 0, F.get("_cells", F.col(f"_at.{k}"))), F.lit(""))
    return x.select(
        *rest, "row_no", text("name").alias("name"), F.trim(F.regexp_replace(text("manufacturer"), r"^[ \-\x{2010}-\x{2015}]+", "")).alias("manufacturer"),
        F.nullif(text("expiry"), F.lit("")).alias("expiry"), *[shown_number(text(k)).alias(k) for k in ("price", "pack", "min_order", "stock")],
        F.coalesce(F.get("_heads", F.col("_at.price")), F.lit("")).alias("price_header"), "missing",
    ).where("name <> '' OR price IS NOT NULL")


def unified_items(items: DataFrame, lists: DataFrame, source: str, aliases: Column) -> DataFrame:
    """Rows of ``price_items`` (with ``list_id``) as items of one shape for all sources.

    ``lists``: list_id, list_name, distributor. The manufacturer is resolved from its column, else from the name; the pack is the
    pack column, else the least order.
    """
    x = with_maker(items.join(lists, "list_id"), "manufacturer", "name", aliases, "maker", "")
    return x.select(
        F.lit(source).alias("source"), "list_id", "list_name", "distributor", F.col("name").alias("product_name"), F.col("maker").alias("manufacturer"),
        F.col("price").alias("distributor_price"), "stock", F.when(F.col("pack") != 0, F.col("pack")).otherwise(F.col("min_order")).alias("pack_quantity"), F.col("expiry").alias("expiry_date"),
        F.to_json(F.struct(F.lit(source).alias("source"), F.col("list_id").alias("priceListId"), F.col("row_no").alias("rowNumber"), F.coalesce(F.col("min_order").cast("string"), F.lit("")).alias("minOrder"), F.col("price_header").alias("priceHeader"))).alias("raw"),
    )
