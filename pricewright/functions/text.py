"""Text and identifier normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of units, counts and prices in product names, Latin and Cyrillic.
UNIT = r"(?iU)(\d+(?:[.,]\d+)?)\s*(мкг|мг|гр|г|мл|л|ме|%|mcg|mg|g|ml|l|iu)(?![\p{L}\d])"
PACK = r"(?iU)(?<![\p{L}\d])(?:№|n|no|номер)\s*(\d+)"
PACKS = (
    r"(?iU)(?:№|n)\s*\d+\b",
    r"(?iU)\b\d+\s*(?:таб|табл|капс|кап|амп|фл|пак|саше|шт)\b",
    r"(?iU)\b\d+(?:[,.]\d+)?\s*(?:мл|л|г|мг|мкг|кг)\b",
    r"(?iU)\b\d+(?:[,.]\d+)?\s*(?:мг|мкг|г)\s*/\s*(?:мл|г)\b",
    r"(?iU)\b\d+(?:[,.]\d+)?\s*%\s*\d*(?:[,.]\d+)?\s*(?:г|мл)?\b",
)
PRICE_NOISE = (r"(?iU)(?<!\w)\d+(?:[,.]\d+)?\s*(?:тг|тенге|kzt|₸)(?!\w)", r"(?iU)\bцена\b.*$")


def blank_to_null(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    t = F.trim(c)
    return F.when(t != "", t)


def first_filled(*cs: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in cs])


def external_sku(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(F.trim(c), r"(?U)\s+", "")


def sku18(c: Column, width: int = 18) -> Column:
    """Digits after the last underscore, the last ``width`` of them, padded with zeros; none: null."""
    digits = F.regexp_replace(F.substring_index(F.trim(c), "_", -1), r"\D", "")
    return F.when(digits != "", F.lpad(F.right(digits, F.lit(width)), width, "0"))


def composite_sku(c: Column) -> Column:
    """Joined by underscores, if it has three filled parts at least; else null."""
    parts = F.filter(F.transform(F.split(F.trim(c), "_"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.array_join(parts, "_"))


def sku_loose(c: Column) -> Column:
    """Without leading zeros; one zero stays."""
    return F.regexp_replace(F.trim(c), r"^0+(?=.)", "")


def sku_plain(c: Column) -> Column:
    """Without a trailing ``.0``, spaces and dashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.0$", ""), r"[\s-]", "")


def sku_variants(c: Column) -> Column:
    """Distinct spellings of one id, in order: as given, padded, without zeros, composite."""
    bare = external_sku(c)
    return F.array_distinct(F.filter(F.array(F.when(bare != "", bare), sku18(c), sku_loose(F.when(bare.rlike(r"^\d+$"), bare)), composite_sku(c)), lambda x: x.isNotNull()))


def barcode(c: Column) -> Column:
    """6 to 18 digits, else empty."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits).between(6, 18), digits).otherwise("")


def text_key(c: Column) -> Column:
    """Lower case, ё as е, everything but letters, digits, underscores and the signs of numbers (``%/.,+-``) as one space."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w%/.,+-]+", " "), r"(?U)\s+", " "))


def sku_key(c: Column) -> Column:
    """``barcode:`` and 6 to 18 digits, else ``sku:`` and the letters, digits, dashes and underscores; nothing left: empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    bar, key = barcode(t), F.regexp_replace(text_key(t), r"[^a-zа-я0-9_-]+", "")
    return F.when(bar != "", F.concat(F.lit("barcode:"), bar)).when(key != "", F.concat(F.lit("sku:"), key)).otherwise("")


def sku_lookup(c: Column) -> Column:
    """Distinct keys by which an id is looked up: bare, padded, then its other spellings."""
    bare = external_sku(c.cast("string"))
    return F.array_distinct(F.filter(F.concat(F.array(F.when(bare != "", bare), sku18(c.cast("string"))), sku_variants(c.cast("string"))), lambda x: x.isNotNull()))


def pack_signature_of(name: Column) -> Column:
    """Counts, volumes, doses and shares in a name: the first six different ones, blanks taken out, joined by ``|``."""
    return packs_in(text_key(name))


def packs_in(t: Column) -> Column:
    """``pack_signature_of`` for a text key; it is read once per pattern."""
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in PACKS]))
    return F.array_join(F.slice(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))), 1, 6), "|")


def name_key(c: Column) -> Column:
    """Lower case letters of Latin and Cyrillic and digits, single spaces."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(low, r"[^0-9a-zа-я]+", " "))


def without_price_noise(c: Column) -> Column:
    """The text key of a name whose prices and ``цена ...`` tail are taken out."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")
    for pattern in PRICE_NOISE:
        c = F.regexp_replace(c, pattern, " ")
    return text_key(c)


def identity_key(*cs: Column) -> Column:
    """Parts joined by ``|``; null if a part is blank."""
    parts = [blank_to_null(c.cast("string")) for c in cs]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("|", *parts))


def labelled_keys(*pairs: tuple[str, Column]) -> Column:
    """array<struct<kind, key>> without nulls; of equal keys the first kind stays."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in pairs]), lambda x: x["key"].isNotNull())
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["key"]), x["key"]) == i + 1)


def unit_tokens(c: Column) -> Column:
    """``number+unit`` tokens in order, decimal comma as a point, lower case."""
    numbers = F.regexp_extract_all(c, F.lit(UNIT), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(UNIT), F.lit(2))
    return F.zip_with(numbers, units, lambda n, u: F.concat(F.regexp_replace(n, ",", "."), F.lower(u)))


def pack_count(c: Column) -> Column:
    """The number after № or N; else the second-last part of a slashed count."""
    n = F.regexp_extract(c, PACK, 1)
    slashed = F.regexp_extract(c, r"(\d+)\s*/\s*\d+\s*$", 1)
    return F.when(n != "", n.cast("int")).when(slashed != "", slashed.cast("int"))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.split(name_key(c), " "), lambda x: F.length(x) >= least))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def safe_cell(c: Column) -> Column:
    """Against formula injection: ``'`` before = + - @."""
    t = F.trim(F.translate(F.coalesce(c, F.lit("")), " ", " "))
    return F.when(t.rlike(r"^[=+@-]"), F.concat(F.lit("'"), t)).otherwise(t)


def header_key(c: Column) -> Column:
    """A table header for look-up: lower case, words joined by one space."""
    low = F.translate(F.lower(F.coalesce(F.translate(c, "_\n", "  "), F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(low, r"(?U)[^\w]+", " "))


def strip_tags(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def column_title(c: Column) -> Column:
    """Split at em dashes, adjacent repeats (in any case) dropped, joined again."""
    parts = F.filter(F.transform(F.split(c, "—"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(parts, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(parts, i - 1))))
    return F.array_join(kept, " — ")
