"""Raw feed rows to normalised rows, with a reason for each that is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates, makers, text
from ..functions.fence import fix
from .dedup import storage_key

# The names under which feeds carry a field, in order of trust.
GOODS_ID = ("goodsId", "goods_id", "provisor_goods_id")
PRICE = ("goodsPriceWithUserDiscount", "goods.price", "price", "distributor_price")
NAME = ("goods.fullName", "goods_full_name", "fullName", "name", "distributorGoodsName", "goods.name")
MAKER = ("distributorProducer", "manufacturer", "producer", "goods.producer")
DISTRIBUTOR_ID = ("distributorGoodsId", "distributor_goods_id", "sku", "code")
VARIANT = ("distributorGoodsId", "distributor_goods_id", "distributorProductId", "sku", "code", "barcode", "barCode", "ean", "gtin")
PACK = ("box", "pack", "package_count", "packageCount", "quantity", "qty", "dosage", "dose", "volume", "weight", "number")
UPDATED = ("insertedDate", "updatedAt", "updated_at", "source_updated_at", "timestamp")
STOCK = ("stored", "stock", "quantity")
COUNT = ("box", "pack", "package_count")
EXPIRY = ("shelfLife", "expiry_date", "expiryDate")


class Row:
    """Fields of a feed that may or may not be there, as texts; empty ones count as absent."""

    def __init__(self, rows: DataFrame, nested: str = "goods"):
        kind = rows.schema[nested].dataType if nested in rows.columns else None
        inner = kind.names if isinstance(kind, StructType) else []
        self.have = {c: F.col(f"`{c}`") for c in rows.columns if c != nested} | {f"{nested}.{c}": F.col(nested)[c] for c in inner}
        self.nested = nested

    def get(self, name: str) -> Column:
        return F.nullif(self.have[name].cast("string"), F.lit("")) if name in self.have else F.lit(None).cast("string")

    def first(self, *names: str) -> Column:
        """The first of the fields that is filled."""
        return F.coalesce(*[self.get(n) for n in names]) if names else F.lit(None).cast("string")

    def lookup(self, name: str) -> Column:
        """The row's field, else the nested one's."""
        return self.first(name, f"{self.nested}.{name}")


def amount(c: Column) -> Column:
    """A number with blanks and a decimal comma; else null."""
    return F.regexp_replace(F.regexp_replace(c, r"\s", ""), ",", ".").try_cast("decimal(24,6)")


def whole(c: Column) -> Column:
    """Cut to a whole number; else null."""
    return F.trim(c).try_cast("double").cast("bigint")


def price(row: Row) -> tuple[Column, Column]:
    """(price, reason): ``goodsPrice`` decides if it is there; else the first positive of the other fields."""
    own, others = row.get("goodsPrice"), [amount(row.get(n)) for n in PRICE]
    positive = F.coalesce(*[F.when(p > 0, p) for p in others])
    found = F.when(own.isNotNull(), F.when(amount(own) > 0, amount(own))).otherwise(positive)
    reason = F.when(own.isNotNull() | F.coalesce(*others).isNotNull(), "invalid_price").otherwise("missing_price")
    return found, F.when(found.isNull(), reason)


def negative_price(row: Row) -> Column:
    """Whether any of the fields that may carry the price is below zero."""
    return F.exists(F.array(*[amount(row.get(n)) for n in ("goodsPrice", *PRICE)]), lambda p: F.coalesce(p < 0, F.lit(False)))


def variant_key(row: Row) -> Column:
    return F.coalesce(*[F.nullif(text.sku_key(row.lookup(n)), F.lit("")) for n in VARIANT], F.lit(""))


def pack_signature(row: Row, packs: Column) -> Column:
    """The first four filled pack fields as ``field:value``; without any, the name's ``packs``."""
    there = [n for n in PACK if n in row.have or f"{row.nested}.{n}" in row.have]
    given = [F.concat(F.lit(f"{n}:"), F.when(row.lookup(n).isNotNull(), text.text_key(row.lookup(n)))) for n in there]
    filled = F.array_join(F.slice(F.filter(F.array(*given), lambda x: x.isNotNull()), 1, 4), "|") if given else F.lit("")
    return F.coalesce(F.nullif(filled, F.lit("")), packs)


#: Letters of distinct names and makers that may be broadcast with what they become.
TEXTS = 4_000_000


def _texts(rows: DataFrame, aliases: Column) -> DataFrame:
    """What ``_name`` and ``_maker_raw`` become."""
    x = fix(makers.with_maker(rows, "_maker_raw", "_name", aliases, "_found", ""), _maker=F.col("_found"), _key=text.text_key(F.col("_name")))
    return fix(x.drop("_found"), _packs=text.packs_in(F.col("_key")), _producer=text.text_key(F.col("_maker")), _plain=text.without_price_noise(F.col("_name")))


def normalize(rows: DataFrame, filial_id: Column, filial_name: Column, aliases: Column, repeated: bool = False) -> DataFrame:
    """A row for each raw row: the normalised fields, and ``skip_reason`` for what a feed has to leave out.

    The reason is missing_price, invalid_price or missing_name; null for good rows. One projection, no shuffle.
    ``repeated``: for tables whose names and makers come again and again, these are cleaned once each, in a pass of its own, and
    joined to the rows by broadcast; where they have more than ``TEXTS`` letters they are cleaned row by row all the same.
    """
    row = Row(rows)
    cost, reason = price(row)
    x = fix(rows, _name=F.trim(row.first(*NAME)), _maker_raw=row.first(*MAKER), _cost=cost, _reason=reason)
    known = x.select("_name", "_maker_raw").distinct() if repeated else None
    if repeated and (known.agg(F.sum(F.coalesce(F.length("_name"), F.lit(0)) + F.coalesce(F.length("_maker_raw"), F.lit(0)) + 8)).first()[0] or 0) <= TEXTS:
        t = _texts(known, aliases).withColumnsRenamed({"_name": "_n", "_maker_raw": "_m"})
        x = x.join(F.broadcast(t), x["_name"].eqNullSafe(t["_n"]) & x["_maker_raw"].eqNullSafe(t["_m"]))
    else:
        x = _texts(x, aliases)
    name, cost, maker = F.col("_name"), F.col("_cost"), F.col("_maker")
    small = F.to_json(F.struct(row.get("id").alias("id"), row.first(*GOODS_ID).alias("goodsId"), row.first(*DISTRIBUTOR_ID).alias("distributorGoodsId"), name.alias("distributorGoodsName"), cost.cast("string").alias("price")))
    x = x.withColumn("_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return x.select(
        F.coalesce("_reason", F.when(F.coalesce(name, F.lit("")) == "", "missing_name")).alias("skip_reason"), whole(row.get("id")).alias("source_item_id"),
        whole(row.first(*GOODS_ID, "goods.id", "goods.goodsId")).alias("goods_id"), F.coalesce(whole(row.first("filialId", "filial_id")), filial_id.cast("bigint")).alias("filial_id"), filial_name.alias("filial_name"),
        name.alias("name"), blank(row.first("goods.regNumber", "regNumber")).alias("reg_number"), blank(row.first(*DISTRIBUTOR_ID)).alias("distributor_goods_id"), cost.cast("double").alias("price"),
        amount(row.first(*STOCK)).cast("double").alias("stock"), amount(row.first(*COUNT)).cast("double").alias("package_count"), blank(row.first(*EXPIRY)).alias("expiry_date"), maker.alias("manufacturer"),
        F.when(F.length("_json") > 4000, small).otherwise(F.col("_json")).alias("raw_json"), variant_key(row).alias("variant_key"), pack_signature(row, F.col("_packs")).alias("pack_signature"), F.col("_producer").alias("producer_key"),
        F.col("_plain").alias("name_key"), blank(row.first(*UPDATED)).alias("source_timestamp"), negative_price(row).alias("negative_price"),
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("skip_reason IS NULL").drop("skip_reason", "negative_price")


def outcome_counts(normalized: DataFrame) -> DataFrame:
    """How many rows were saved or left out, by reason."""
    return normalized.groupBy(F.coalesce("skip_reason", F.lit("saved")).alias("outcome")).agg(F.count("*").alias("n"))


def identity(goods_id: str = "goods_id") -> Column:
    """What makes two offers the same: goods and variant; goods, pack and maker; else name, maker, pack and variant."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    with_id = F.coalesce(F.col(goods_id) != 0, F.lit(False))
    return (
        F.when(with_id & (text_of("variant_key") != ""), F.array(F.lit("goodsId+variant"), text_of(goods_id), text_of("variant_key")))
        .when(with_id, F.array(F.lit("goodsId+pack+producer"), text_of(goods_id), text_of("pack_signature"), text_of("producer_key")))
        .otherwise(F.array(F.lit("fallback"), text_of("name_key"), text_of("producer_key"), text_of("pack_signature"), text_of("variant_key")))
    )


def logical_key() -> Column:
    """sha256 over the identity and the observation itself: rows that share it are the same observation."""
    return storage_key(F.to_json(identity()), F.col("source_item_id"), F.col("price"), F.col("stock"), F.col("source_timestamp"), F.col("raw_json"))


def quality() -> Column:
    """The better of two offers has the greater struct: price, goods id, variant, longer name, maker, lower price, newer."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        one(F.col("price") > 0).alias("has_price"), one(F.col("goods_id") != 0).alias("has_goods"), one(F.col("variant_key") != "").alias("has_variant"), F.least(F.lit(500), F.length("name")).alias("name_length"),
        one((F.col("producer_key") != "") | (F.col("manufacturer") != "")).alias("has_producer"), (-F.col("price")).alias("cheaper"), F.col("source_timestamp").alias("newer"),
    )


def best_offers(normalized: DataFrame, *also: Column) -> DataFrame:
    """One row per identity, the one of the best quality; of equals the one with the smallest source id; with ``also`` of all its rows. One aggregation."""
    rest = [c for c in normalized.columns if c not in ("skip_reason", "negative_price")]
    score = F.struct(quality().alias("q"), (-F.col("source_item_id")).alias("first"))
    best = normalized.groupBy(identity().alias("identity")).agg(F.max_by(F.struct(*rest), score).alias("b"), F.count("*").alias("rows_seen"), *also)
    return best.select("identity", "rows_seen", *[F.col(f"b.{c}").alias(c) for c in rest], *[c for c in best.columns if c not in ("identity", "b", "rows_seen")])


def as_items(staged: DataFrame, price_list_id: Column) -> DataFrame:
    """Staged rows as items of a price list, not matched to anything yet."""
    empty = {"product_id": "bigint", "matched_sku": "string", "match_method": "string", "match_score": "double"}
    return staged.select(price_list_id.cast("bigint").alias("price_list_id"), *staged.columns, *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def aggregate_in_branch(rows: DataFrame, keys: list[str], price: str, stock: str) -> DataFrame:
    """One row per branch and product: lowest price, summed stock, and of the other columns the first filled by price."""
    rest = [c for c in rows.columns if c not in (*keys, price, stock)]
    return rows.groupBy(*keys).agg(F.min(price).alias(price), F.sum(stock).alias(stock), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(price).alias("p"), F.col(c).cast("string").alias("v")))).alias(c) for c in rest])


# Columns of flat exports and where their values stand.
FLAT = {
    "row_id": "id", "goods_id": "goodsId", "filial_id": "filialId", "filial_name": "filial.name", "distributor_goods_id": "distributorGoodsId", "goods_full_name": "goods.fullName", "distributor_goods_name": "distributorGoodsName",
    "distributor_producer": "distributorProducer", "price": "goodsPrice", "stock": "stored", "shelf_life": "shelfLife", "batch": "batch", "price_status": "priceStatus", "pack": "pack", "box": "box", "multiplicity": "multiplicity", "min_order": "minOrder",
}
SHORT = ("goods_id", "filial_id", "distributor_goods_id", "goods_full_name", "distributor_goods_name", "price", "stock")


def flatten(rows: DataFrame, layout: dict[str, str] = FLAT, columns: tuple[str, ...] | None = None, raw: bool = False) -> DataFrame:
    """Nested feed rows as flat texts, trimmed, empty ones null; dates as yyyy-MM-dd. Fields that a feed lacks are null.

    ``columns``: some of the layout's; ``raw``: with the whole row as JSON.
    """
    have = {c: F.col(f"`{c}`") for c in rows.columns}
    for c in rows.columns:
        if isinstance(rows.schema[c].dataType, StructType):
            have |= {f"{c}.{f}": F.col(f"`{c}`")[f] for f in rows.schema[c].dataType.names}
    out = []
    for name in columns or layout:
        v = F.nullif(F.trim(have[layout[name]].cast("string")), F.lit("")) if layout[name] in have else F.lit(None).cast("string")
        out.append((F.nullif(dates.expiry(v), F.lit("")) if name == "shelf_life" else v).alias(name))
    return rows.select(*out, *([F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw_json")] if raw else []))


# Header words by which a sheet is known, every group needs one of its words.
SHEETS = {
    "products": (("код", "code", "product_code"), ("наименование", "name", "товар"), ("себестоимость", "cost", "закуп")),
    "price_formats": (("цф", "price_format", "format", "код цф"), ("филиал", "branch", "наименование", "name")),
    "markup_ranges": (("стоимость от", "cost_from", "нижняя граница"), ("наценка", "markup", "markup_percent")),
    "universal_lists": (("тип", "type"), ("статус", "status"), ("название", "name")),
    "list_items": (("product_code", "код", "код товара"), ("value", "значение")),
    "competitor_prices": (("source_name", "источник"), ("source_price", "цена"), ("product_code", "код")),
    "competitor_sources": (("source_name", "источник"), ("coefficient", "коэффициент")),
}


def sheet_type(headers: Column) -> Column:
    """What a sheet holds by its header words, first come first; null for none."""
    out = F.lit(None).cast("string")
    for kind, groups in reversed(SHEETS.items()):
        fits = F.lit(True)
        for words in groups:
            fits = fits & F.arrays_overlap(headers, F.array(*map(F.lit, words)))
        out = F.when(fits, kind).otherwise(out)
    return out
