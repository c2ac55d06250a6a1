"""Workbooks of several sheets as tables: each sheet is known by its header, its rows are typed and tied to what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import sku18
from .dedup import best_per_key
from .feed_rows import SHEETS, sheet_type

#: Words of all known headers, for the reader to find a header row by.
WORDS = frozenset(w for groups in SHEETS.values() for words in groups for w in words)
SCHEMAS = {
    "price_formats": "code string, name string, branch string, progib double", "products": "code string, name string, cost double",
    "markup_ranges": "format string, cost_from double, cost_to double, markup double", "universal_lists": "list string, code string, name string, type string, status string, start_date date, end_date date, format string",
    "list_items": "list string, product string, value double", "competitor_sources": "format string, source string, coefficient double, supplier string",
    "competitor_prices": "format string, product string, source string, supplier string, price_date date, price double",
}


def _cell(*names: str) -> Column:
    """The cell under the first of these headers that the sheet has, blank as null."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains("headers", n), F.col("cells")[n]).otherwise(out)
    return F.nullif(F.trim(out), F.lit(""))


def _number(*names: str) -> Column:
    return numbers.tolerant_decimal(_cell(*names)).cast("double")


def _code(*names: str) -> Column:
    return F.coalesce(F.nullif(sku18(_cell(*names)), F.lit("")), _cell(*names))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    return best_per_key(rows, list(keys), F.desc("at")).drop("at")


def _merged(rows: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Per key the last value of each column that isn't null."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in cols])


def load(rows: DataFrame, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The seven tables of ``SCHEMAS`` from the rows of ``read_xlsx``, whatever the order of the sheets.

    Of rows with one key the last stands, by file, sheet and row; for formats and suppliers each cell that isn't blank. What refers to a format, product or list is
    left out if neither the workbook nor ``existing`` (tables of the same names) has it. A list is known by its code, else
    by name and type; items find theirs by code, else by name (of several the smallest key).
    """
    existing = existing or {}
    low = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    pairs = F.transform(F.map_entries("cells"), lambda e: F.struct(low(e["key"]).alias("key"), e["value"].alias("value")))
    # of headers that differ in case or blanks alone the last stands
    x = rows.withColumn("pairs", pairs).withColumn("names", F.reverse(F.transform("pairs", lambda e: e["key"])))
    x = x.withColumn("cells", F.map_from_entries(F.filter("pairs", lambda e, i: F.array_position("names", e["key"]) == F.size("names") - i))).drop("pairs", "names")
    x = x.withColumn("headers", F.transform("headers", low)).withColumn("at", F.struct("file", "sheet_no", "_row"))
    x = x.withColumn("kind", sheet_type(F.col("headers")))
    of = lambda kind: x.where(F.col("kind") == kind)
    known = lambda kind, col, new: new.select(col).unionByName(existing[kind].select(col)).distinct() if kind in existing else new.select(col).distinct()
    out = {}
    f = of("price_formats").select("at", _cell("код цф", "цф", "code", "price_format", "format").alias("code"), _cell("наименование", "name").alias("name"), _cell("филиал", "branch").alias("branch"), _number("прогиб", "deflection", "progib").alias("progib"))
    out["price_formats"] = _merged(f.where("code IS NOT NULL"), ["code"], "name", "branch", "progib").withColumn("name", F.coalesce("name", "code"))
    p = of("products").select("at", _code("код", "code", "product_code").alias("code"), _cell("наименование", "name", "товар").alias("name"), _number("себестоимость", "cost", "закуп").alias("cost"))
    out["products"] = _last(p.where("code IS NOT NULL"), "code").withColumns({"name": F.coalesce("name", "code"), "cost": F.coalesce("cost", F.lit(0.0))})
    formats, products = known("price_formats", "code", out["price_formats"]).withColumnRenamed("code", "format"), known("products", "code", out["products"]).withColumnRenamed("code", "product")
    fmt = _cell("код цф", "price_format_code", "цф").alias("format")

    m = of("markup_ranges").select("at", fmt, _number("стоимость от", "cost_from", "нижняя граница").alias("cost_from"), _number("стоимость до", "cost_to", "верхняя граница").alias("cost_to"), F.coalesce(_number("наценка", "markup", "markup_percent", "наценка %"), F.lit(0.0)).alias("markup"))
    m = m.where("format IS NOT NULL AND cost_from IS NOT NULL").withColumn("markup", F.when(F.col("markup") > 1, F.col("markup") / 100).otherwise(F.col("markup")))
    out["markup_ranges"] = _last(m.join(formats, "format", "left_semi"), "format", "cost_from", "cost_to")

    status = _cell("статус", "status")
    u = of("universal_lists").select(
        "at", _cell("код", "code", "list_code").alias("code"), _cell("название", "name").alias("name"), _cell("тип", "type").alias("type"),
        F.when(F.lower(status).startswith("актив"), "Активный").otherwise(F.coalesce(status, F.lit("Не активный"))).alias("status"),
        dates.cell_date(_cell("дата начала", "start_date", "start")).alias("start_date"), dates.cell_date(_cell("дата окончания", "end_date", "end")).alias("end_date"), fmt,
    ).where("name IS NOT NULL AND type IS NOT NULL")
    coded = u.where("code IS NOT NULL").groupBy("name", "type").agg(F.min("code").alias("_code"))
    u = u.join(coded, ["name", "type"], "left").withColumn("code", F.coalesce("code", "_code")).withColumn("list", F.coalesce("code", F.concat_ws("|", "name", "type")))
    u = u.join(formats.withColumn("_f", F.col("format")), "format", "left").withColumn("format", F.col("_f"))
    out["universal_lists"] = _last(u, "list").select("list", "code", "name", "type", "status", "start_date", "end_date", "format")
    lists = out["universal_lists"].select("list", "code", "name")
    if "universal_lists" in existing:
        lists = lists.unionByName(existing["universal_lists"].select("list", "code", "name")).distinct()

    i = of("list_items").select("at", _cell("list_code", "код списка", "код").alias("list_code"), _cell("list_name", "список", "название").alias("list_name"), _code("product_code", "код товара", "код").alias("product"), _number("value", "значение").alias("value"))
    i = i.where("product IS NOT NULL AND value IS NOT NULL").join(products, "product", "left_semi")
    by_code = lists.where("code IS NOT NULL").groupBy(F.col("code").alias("list_code")).agg(F.min("list").alias("_c"))
    by_name = lists.groupBy(F.col("name").alias("list_name")).agg(F.min("list").alias("_n"))
    i = i.join(by_code, "list_code", "left").join(by_name, "list_name", "left").withColumn("list", F.coalesce("_c", "_n"))
    out["list_items"] = _last(i.where("list IS NOT NULL").select("at", "list", "product", "value"), "list", "product")

    source, supplier = _cell("source_name", "источник").alias("source"), _cell("поставщик", "supplier").alias("supplier")
    s = of("competitor_sources").select("at", fmt, source, F.coalesce(_number("coefficient", "коэффициент"), F.lit(1.0)).alias("coefficient"), supplier)
    out["competitor_sources"] = _merged(s.where("format IS NOT NULL AND source IS NOT NULL").join(formats, "format", "left_semi"), ["format", "source"], "coefficient", "supplier")
    c = of("competitor_prices").select("at", fmt, _code("product_code", "код", "код товара").alias("product"), source, supplier, dates.cell_date(_cell("price_date", "дата", "date")).alias("price_date"), _number("source_price", "цена").alias("price"))
    c = c.where("format IS NOT NULL AND product IS NOT NULL AND source IS NOT NULL").join(formats, "format", "left_semi").join(products, "product", "left_semi")
    keys = ["format", "product", "source"]
    out["competitor_prices"] = _merged(c, keys, "supplier").join(_last(c.drop("supplier"), *keys), keys)
    return {kind: out[kind].select([f.split()[0] for f in schema.split(", ")]) for kind, schema in SCHEMAS.items()}
