"""Typed cells of imported lists, tolerant JSON and small numeric forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import list_type
from .numbers import FINE, flag, percent_points, tolerant_decimal

# Which list types hold percentages, flags, and prices that can't be negative.
MARKUPS = ("critical_markup", "min_markup", "max_markup", "fixed_markup", "markup", "percentile_override")
FLAGS = ("exclusion", "exclude_from_pricing", "no_bend")
PRICES = ("fixed_price", "min_price", "max_price")


def list_value(kind: Column, raw: Column) -> Column:
    """struct<value, special, error> of a list's cell by the list's type.

    A critical markup may be ``-``: no override. Flags count as 1 when empty; a
    memorandum needs a positive price; fixed, least and greatest prices can't be negative.
    """
    k, cell = list_type(kind), F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    dash = (k == "critical_markup") & (cell == "-")
    yes = F.when(cell == "", True).otherwise(flag(cell))
    number, percent = tolerant_decimal(cell), percent_points(cell)
    value = F.when(k.isin(*MARKUPS), percent).when(k.isin(*FLAGS), yes.cast("int").cast(FINE)).otherwise(number)
    error = (
        F.when(k.isin(*MARKUPS), F.when(percent.isNull(), "invalid markup value")).when(k.isin(*FLAGS), F.when(yes.isNull(), "invalid exclusion value"))
        .when((k == "memorandum") & number.isNull(), "missing_price").when((k == "memorandum") & (number <= 0), "price_not_positive")
        .when(number.isNull(), "invalid numeric value").when(k.isin(*PRICES) & (number < 0), "negative_price")
    )
    return F.struct(F.when(dash, F.lit(0).cast(FINE)).when(error.isNull(), value).alias("value"), F.when(dash, "-").otherwise("").alias("special"), F.when(~dash, error).alias("error"))


def bare_decimal(c: Column) -> Column:
    """Digits, point and minus of a text with whatever else; a comma is a point."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), ",", "."), r"[^0-9.\-]", "").try_cast("decimal(24,6)")


def positive_whole(c: Column) -> Column:
    """A positive whole number, 5.0 too; else null."""
    n = tolerant_decimal(c)
    return F.when((n > 0) & (n == F.floor(n)), n.cast("bigint"))


def comma_decimal(c: Column) -> Column:
    """Two places after a decimal comma; what is no number stays as it is."""
    n = bare_decimal(c)
    return F.when(n.isNotNull(), F.regexp_replace(n.cast("decimal(24,2)").cast("string"), r"\.", ",")).otherwise(c)


def valid_coefficient(c: Column) -> Column:
    """The coefficient within 0.01 .. 100; anything else is an error."""
    return F.when(c.between(0.01, 100), c.cast(FINE)).otherwise(F.raise_error(F.lit("coefficient must be between 0.01 and 100")).cast(FINE))


def dose_mg(c: Column) -> Column:
    """Decimals below one are grams in supplier names."""
    return F.when((c > 0) & (c < 1), c * 1000).otherwise(c).cast("double")


def clean_number(c: Column) -> Column:
    """Four places at most, as text; whole numbers without a point."""
    r = F.round(c, 4)
    return F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(r.cast("string"))


def id_list(c: Column) -> Column:
    """A JSON array of whole numbers; what is none is an empty list."""
    return F.coalesce(F.filter(F.from_json(c, "array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def json_strings(c: Column) -> Column:
    """The filled texts of a JSON array, trimmed; what is none is an empty list."""
    return F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def json_map(c: Column) -> Column:
    """A JSON object as map<string,string>; what is none is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def sample(values: Column, limit: int = 5) -> Column:
    """The first filled different values of an array."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))), 1, limit)


def pairs(c: Column) -> Column:
    """``k:v; k:v`` as a map; parts without a colon are left out."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))


def region_status(c: Column) -> Column:
    """What stands after ``status:`` in a region's text, up to a semicolon; else empty."""
    return F.trim(F.regexp_extract(c, r"status:([^;]*)", 1))


def filled_row(cells: Column) -> Column:
    """Whether any of a row's cells is filled."""
    return F.exists(cells, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def allowed_source(source: Column, city: Column, table: dict[int, list[int]]) -> Column:
    """Whether a city's allow-list names the source; cities without a list allow none, a null city all."""
    rule = F.lit(False)
    for k, sources in table.items():
        rule = rule | ((city == k) & source.isin(*sources))
    return F.when(city.isNull(), True).otherwise(rule)
