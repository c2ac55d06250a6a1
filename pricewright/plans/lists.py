"""Lists, their assignments and the price rows they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lists
from .catalog import query
from .tables import Tables


@query("SELECT s_suppkey AS list_id, s_suppkey % 4 > 0 AND s_suppkey % 11 > 0 AND s_suppkey % 5 NOT IN (1, 2) AS usable FROM supplier")
def q_usable_lists(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    kind, status = F.when(k % 4 == 0, "Emit").otherwise("provisor"), F.when(k % 5 == 1, " FAILED").when(k % 5 == 2, "stale").when(k % 5 == 3, "ok").otherwise(None)
    x = t.supplier.select(k.alias("list_id"), kind.alias("kind"), F.when(k % 11 == 0, " ").otherwise(F.col("s_name")).alias("name"), status.alias("status"))
    return x.select("list_id", lists.usable(F.lit(None), F.col("kind"), F.col("name"), F.col("status"), F.col("name")).alias("usable"))


@query("SELECT l_orderkey, l_linenumber, l_quantity > 10 AND (l_partkey % 2 = 0 OR l_suppkey % 3 = 0) AS counts FROM lineitem")
def q_priced_items(t: Tables) -> DataFrame:
    ids = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey").cast("string")).otherwise(" ")
    return t.lineitem.select("l_orderkey", "l_linenumber", lists.priced_and_known(F.when(F.col("l_quantity") != 11, F.col("l_quantity") - 10).otherwise(1), *ids).alias("counts"))


@query("SELECT c_nationkey AS format_id, c_custkey AS list_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY last DESC NULLS LAST, c_custkey DESC) AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0")
def q_assigned_lists(t: Tables) -> DataFrame:
    """Customers as lists, their nations as formats."""
    last = t.orders.groupBy(F.col("o_custkey").alias("list_id")).agg(F.max("o_orderdate").alias("updated_at"))
    known = t.customer.select(F.col("c_custkey").alias("list_id")).join(last, "list_id", "left")
    given = t.customer.select(F.col("c_custkey").alias("list_id"), F.col("c_nationkey").alias("format_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return lists.assigned(known, given).select("format_id", "list_id", "place")


@query("WITH l AS (SELECT s_suppkey AS list_id, s_nationkey AS format_id, s_name AS source FROM supplier WHERE s_acctbal > 0) SELECT format_id, l_partkey AS product, source, l_extendedprice AS price, 1.5 AS coefficient FROM lineitem JOIN l ON l_suppkey = list_id WHERE l_quantity > 5 UNION ALL SELECT s_nationkey, ps, s_name, 1.0, 2.0 FROM supplier, (SELECT unnest([NULL, 1, 2]) AS ps) WHERE s_acctbal <= 0 OR ps IS NULL")
def q_price_rows(t: Tables) -> DataFrame:
    """Former rows of suppliers whose list is new go, settings without a product and other suppliers' rows stay."""
    old = t.supplier.select(F.col("s_nationkey").alias("format_id"), F.explode(F.array(F.lit(None), F.lit(1), F.lit(2)).cast("array<bigint>")).alias("product"), F.col("s_name").alias("source"), F.lit(1.0).alias("price"), F.lit(2.0).alias("coefficient"))
    new = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("list_id"), F.col("s_nationkey").alias("format_id"), F.col("s_name").alias("source"), F.lit(1.5).alias("coefficient"))
    items = t.lineitem.select(F.col("l_suppkey").alias("list_id"), F.col("l_partkey").alias("product"), F.when(F.col("l_quantity") > 5, "x").otherwise("").alias("matched_sku"), F.col("l_extendedprice").alias("price"))
    return lists.price_rows(old, items, new)


@query("SELECT o_orderkey AS row, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS product, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 + 1 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 7 + 1 END END AS price, CASE WHEN o_orderkey % 13 = 0 THEN 'no_sku' WHEN c_custkey IS NULL THEN 'no_product' WHEN o_orderkey % 3 = 2 THEN 'no_price' ELSE 'priced' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20 AND o_orderkey % 13 > 0")
def q_feed_prices(t: Tables) -> DataFrame:
    """Orders as feed rows whose ids are written in several ways, customers of some nations as products."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    sku = F.when(k % 13 == 0, " ").when(k % 2 == 0, F.lpad(c, 18, "0")).otherwise(F.concat(F.lit(" "), c))
    feed = t.orders.select(k.alias("row"), sku.alias("sku"), F.when(k % 3 == 0, k % 10 + 1).otherwise(0).alias("discounted"), F.when(k % 3 == 1, k % 7 + 1).when(k % 3 == 0, 99).alias("listed"))
    products = t.customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("product"), F.concat(F.lit("00"), "c_custkey").alias("sku"))
    return lists.feed_prices(feed, products).select("row", "product", "price", "outcome")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'goods_id=provisor:goods_id:' || o_custkey || ',' ELSE '' END || CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'goods_distributor_composite=provisor:goods_distributor_composite:' || o_custkey || '_' || o_orderkey || ',' ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN 'goods_id_shelf_life=provisor:goods_id_shelf_life:' || o_custkey || '_' || strftime(o_orderdate, '%Y-%m-%d') || ',' ELSE '' END || CASE WHEN o_orderkey % 3 = 1 THEN 'reference_sku=provisor:reference_sku:' || o_orderkey || ',reference_sku=provisor:reference_sku:' || lpad(o_orderkey::VARCHAR, 18, '0') || ',' ELSE '' END AS keys FROM orders")
def q_supplier_keys(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    goods, own = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")), F.when(k % 3 > 0, k.cast("string"))
    keys = lists.supplier_keys(goods, own, F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 3 == 1, 128).otherwise(5))
    return t.orders.select("o_orderkey", F.array_join(F.transform(keys, lambda x: F.concat(x["kind"], F.lit("="), x["key"], F.lit(","))), "").alias("keys"))
