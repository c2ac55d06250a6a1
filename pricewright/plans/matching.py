"""Matching and linking: queries over parts written as products and as supplier items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, structure
from .catalog import query
from .tables import Tables

_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"


def _products(t: Tables) -> DataFrame:
    """Parts as products; their makers have unlike names, so that no two are taken for one."""
    name = F.concat("p_name", F.lit(" "), "p_size", F.lit("мг таб N10"))
    return matching.prepared(t.part.select(F.col("p_partkey").alias("product"), name.alias("name"), F.md5("p_brand").alias("maker")), "name", "maker")


def _items(t: Tables) -> DataFrame:
    """Every part in another spelling, with a price; each tenth has a dose that no product has."""
    dose = F.when((F.col("p_partkey") % 10 == 0) & (F.col("p_size") != 7), F.col("p_size") + 1000).otherwise(F.col("p_size"))
    name = F.concat(F.upper("p_name"), F.lit(" "), dose, F.lit(" MG таблетки №10"))
    price = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return matching.prepared(t.part.select((F.col("p_partkey") + 1000000).alias("item"), name.alias("name"), F.md5("p_brand").alias("maker"), price.alias("price"), "p_partkey"), "name", "maker")


_MATCH = f"""WITH manual AS (SELECT p_partkey AS product, p_partkey + 1000000 AS item FROM part WHERE p_size = 7),
 i AS (SELECT p_partkey + 1000000 AS item, p_name, p_brand, p_size, {_CENTS} AS price FROM part WHERE p_partkey % 10 <> 0 AND p_size <> 7), p AS (SELECT p_partkey AS product, p_name, p_brand, p_size FROM part WHERE p_size <> 7),
 pr AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY product) AS r FROM p), ir AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY price, item) AS r FROM i),
 c AS (SELECT product, item FROM pr JOIN ir USING (p_name, p_brand, p_size, r)), rest AS (SELECT product FROM p ANTI JOIN c USING (product)), free AS (SELECT item, p_name, p_size, price FROM i ANTI JOIN c USING (item)),
 q AS (SELECT product, p_name, p_size, row_number() OVER (PARTITION BY p_name, p_size ORDER BY product) AS r FROM p JOIN rest USING (product)), f AS (SELECT item, p_name, p_size, row_number() OVER (PARTITION BY p_name, p_size ORDER BY price, item) AS r FROM free) """


@query(_MATCH + "SELECT product, item, 'manual' AS method FROM manual UNION ALL SELECT product, item, 'composite' FROM c UNION ALL SELECT product, item, 'name' FROM q JOIN f USING (p_name, p_size, r)")
def q_match_cascade(t: Tables) -> DataFrame:
    """Manual links, then composite keys, then equal names of any maker; each product and item once."""
    products, items = _products(t).checkpoint(), _items(t).checkpoint()
    sevens = t.part.where("p_size = 7").select(F.col("p_partkey").alias("product"), (F.col("p_partkey") + 1000000).alias("item"), F.lit(0).cast("bigint").alias("price"))
    named = products.where("base IS NOT NULL AND struct.dosage IS NOT NULL").select("product", F.struct("base", "struct.dosage").alias("p"))
    offered = items.where("base IS NOT NULL AND struct.dosage IS NOT NULL").select("item", "price", F.struct("base", "struct.dosage").alias("i"))
    links = named.select("p").distinct().join(offered.select("i").distinct(), F.col("p") == F.col("i"))
    return matching.cascade([("manual", sevens), ("composite", matching.composite_classes(products, items)), ("name", matching.Alike(links, named, offered))], F.col("price"))


@query("SELECT p_partkey, 'ok' AS same, CASE p_size % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'reject' ELSE 'ok' END AS decision, CASE p_size % 4 WHEN 0 THEN 'dosage_conflict' WHEN 2 THEN 'form_conflict' END AS conflict, CASE p_size % 4 WHEN 1 THEN 'missing_candidate_quantity' END AS missing, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS matched, CASE p_size % 4 WHEN 1 THEN 1 ELSE 0 END AS absent, 'composite:base:' || p_name || ':quantity:10,composite:base:' || p_name || ':dosage:' || p_size || ',composite:first:' || split_part(p_name, ' ', 1) || ':quantity:10,composite:first:' || split_part(p_name, ' ', 1) || ':dosage:' || p_size AS keys, 'exact:' || p_name || '|m|10|dosage:' || p_size || '|||ТАБ|,relaxed1:' || p_name || '|m|10|dosage:' || p_size || ',relaxed2:' || p_name || '|m||ТАБ,relaxed3:' || p_name || '|m||ТАБ' AS composite FROM part")
def q_structure_decisions(t: Tables) -> DataFrame:
    k, n, s = F.col("p_size") % 4, F.col("p_name"), F.col("p_size")
    one = F.concat(n, F.lit(" "), s, F.lit("мг таб N10"))
    two = F.when(k == 0, F.concat(n, F.lit(" "), s + 1, F.lit("мг таб N10"))).when(k == 1, F.concat(n, F.lit(" "), s, F.lit("мг таб"))).when(k == 2, F.concat(n, F.lit(" "), s, F.lit("мг сироп N10"))).otherwise(F.concat(n, F.lit(" "), s, F.lit(" MG tablets №10")))
    x = t.part.select("p_partkey", structure.structure(one).alias("a"), structure.structure(two).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(
        "p_partkey", structure.decision(a, a).alias("same"), structure.decision(a, b).alias("decision"), structure.mismatch(a, b).alias("conflict"), structure.missing(a, b).alias("missing"), structure.counts(a, b)["matched"].alias("matched"), structure.counts(a, b)["missing"].alias("absent"),
        F.array_join(structure.index_keys(a["base"], a), ",").alias("keys"), F.array_join(structure.composite_keys(a["base"], F.lit("m"), a), ",").alias("composite"),
    )


@query("SELECT p_partkey, CASE WHEN p_size < 34 THEN NULL WHEN greatest(0, least(100, p_size * 1.2 + CASE WHEN p_size % 3 = 0 THEN 18 WHEN p_size % 3 = 1 THEN -6 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 8 ELSE -8 END + 6 + 4)) < 55 THEN NULL ELSE round(greatest(0, least(100, p_size * 1.2 + CASE WHEN p_size % 3 = 0 THEN 18 WHEN p_size % 3 = 1 THEN -6 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 8 ELSE -8 END + 6 + 4)), 2) END AS score, CASE WHEN p_size * 2 >= 98 OR p_size * 2 >= 95 THEN 'AUTO' ELSE 'REVIEW' END AS safe FROM part")
def q_manual_score(t: Tables) -> DataFrame:
    s = F.col("p_size")
    got = matching.manual_score(s * F.lit(2.0), F.when(s % 3 == 0, 2).otherwise(0), s % 3 == 1, s % 2 == 0, F.lit(True), F.lit(50.0))
    return t.part.select("p_partkey", got.alias("score"), matching.safe_match(s * 2, F.lit(2)).alias("safe"))


@query("SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey + 5 ELSE CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END END AS product, CASE o_custkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'manual' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE 'none' END END AS how FROM orders")
def q_manual_links(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    links = t.customer.select(F.concat(F.lit("vidman:"), k).alias("match_key"), (k + 5).alias("product"), F.when(k % 4 == 0, "rejected").when(k % 4 == 1, "approved").otherwise("draft").alias("status"))
    items = t.orders.select("o_orderkey", F.concat(F.lit("vidman:"), "o_custkey").alias("match_key"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("product"))
    return matching.apply_manual(items, links).select("o_orderkey", "product", "how")


_MAPPED = "WITH m AS (SELECT p_partkey AS product, p_name, CASE WHEN p_size % 5 = 0 THEN 'manual' WHEN p_size % 2 = 0 THEN 'primary' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 'item' ELSE 'unmapped' END AS mapped_by FROM part) "


def _mapped(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    products = t.part.select(k.alias("product"), F.when(F.col("p_size") % 2 == 0, k).alias("goods_id"))
    links = t.part.select(k.alias("product"), F.when(F.col("p_size") % 5 == 0, "approved").otherwise("draft").alias("status"))
    return matching.mapped(products, links, t.lineitem.select(F.when(F.col("l_quantity") > 45, F.col("l_partkey")).alias("product")))


@query(_MAPPED + "SELECT mapped_by, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS share FROM m GROUP BY ALL")
def q_mapping_coverage(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("all"))
    return _mapped(t).groupBy("mapped_by").agg(F.count("*").alias("n")).join(F.broadcast(n), how="cross").select("mapped_by", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("share"))  # one row


@query(_MAPPED + "SELECT product, p_name AS name, mapped_by FROM m WHERE contains(p_name, 'ring') AND mapped_by = 'manual' ORDER BY product LIMIT 3")
def q_mapping_page(t: Tables) -> DataFrame:
    """A page number below the first is held to it."""
    products = t.part.select(F.col("p_partkey").alias("product"), F.upper("p_name").alias("name"))
    return matching.mapping_page(products, _mapped(t), "Ring", "manual", 0, 3).select("product", F.lower("name").alias("name"), "mapped_by")


@query("SELECT DISTINCT l_partkey AS goods_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def q_needed_ids(t: Tables) -> DataFrame:
    reference = t.lineitem.select(F.col("l_partkey").alias("goods_id"), F.when(F.col("l_linenumber") % 2 == 0, F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).otherwise(F.col("l_suppkey").cast("string")).alias("sku"))
    wanted = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("00"), "s_suppkey").alias("sku"))
    return matching.needed_ids(reference, wanted)


@query("SELECT o_orderpriority AS feed, count(DISTINCT o_custkey) AS ids, count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) THEN o_custkey END) AS matched FROM orders WHERE o_custkey > 0 GROUP BY ALL")
def q_sku_overlap(t: Tables) -> DataFrame:
    feeds = t.orders.where("o_custkey > 0").select(F.col("o_orderpriority").alias("feed"), F.lpad(F.col("o_custkey").cast("string"), 18, "0").alias("sku"))
    return matching.variant_overlap(feeds, t.customer.where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("sku")))


@query("WITH b AS (SELECT p_name AS k, min(p_size) AS g, count(DISTINCT p_size) AS n FROM part WHERE p_brand < 'Brand#2' GROUP BY 1) SELECT DISTINCT p_name AS name, CASE WHEN n = 1 THEN g END AS goods_id, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS status FROM part LEFT JOIN b ON p_name = k")
def q_name_bridge(t: Tables) -> DataFrame:
    return matching.name_bridge(t.part.select(F.col("p_name").alias("name")), t.part.select(F.col("p_name").alias("name"), F.when(F.col("p_brand") < "Brand#2", F.col("p_size")).alias("goods_id")), "name", "goods_id")


@query("WITH p AS (SELECT c_custkey AS product, CASE WHEN c_nationkey < 5 THEN c_custkey END AS goods_id FROM customer), l AS (SELECT o_custkey AS product, min(g) AS g, count(DISTINCT g) AS n FROM (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 1000000 + o_custkey // 6 ELSE 2000000 + o_custkey END AS g FROM orders) GROUP BY 1), x AS (SELECT p.*, g, n, count(*) OVER (PARTITION BY CASE WHEN n = 1 THEN g END) AS c FROM p LEFT JOIN l USING (product)) "
       "SELECT product, CASE WHEN goods_id IS NULL AND n = 1 AND c = 1 THEN g ELSE goods_id END AS goods_id, CASE WHEN goods_id IS NOT NULL THEN CASE WHEN n IS NULL OR n = 1 AND g = goods_id THEN 'kept' ELSE 'conflict' END WHEN n IS NULL THEN 'none' WHEN n > 1 OR c > 1 THEN 'shared' ELSE 'filled' END AS outcome FROM x")  # fmt: skip
def q_fill_ids(t: Tables) -> DataFrame:
    products = t.customer.select(F.col("c_custkey").alias("product"), F.when(F.col("c_nationkey") < 5, F.col("c_custkey")).alias("goods_id"))
    k = F.col("o_custkey")
    links = t.orders.select(k.alias("product"), F.when(k % 3 == 0, 1000000 + F.expr("o_custkey DIV 6")).otherwise(2000000 + k).alias("goods_id"))
    return matching.fill_ids(products, links)


@query("WITH s AS (SELECT l_orderkey AS product, l_partkey AS goods_id, l_linenumber AS priority FROM lineitem WHERE l_returnflag = 'R'), pr AS (SELECT p_partkey AS goods_id, p_size AS price FROM part WHERE p_size < 25), f AS (SELECT product, arg_min(price, (priority, goods_id)) AS price, arg_min(s.goods_id, (priority, s.goods_id)) AS g FROM s JOIN pr USING (goods_id) GROUP BY product) SELECT o_orderkey AS product, coalesce(pr.price, f.price) AS price, CASE WHEN pr.price IS NULL THEN g END AS substitute FROM orders LEFT JOIN pr ON pr.goods_id = o_custkey LEFT JOIN f ON f.product = o_orderkey")
def q_substitutes(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("product"), F.col("l_partkey").alias("goods_id"), F.col("l_linenumber").alias("priority"), F.when(F.col("l_returnflag") == "R", "approved").otherwise("draft").alias("status"))
    prices = t.part.where("p_size < 25").select(F.col("p_partkey").alias("goods_id"), F.col("p_size").alias("price"))
    return matching.price_or_substitute(t.orders.select(F.col("o_orderkey").alias("product"), F.col("o_custkey").alias("goods_id")), matching.substitutes(links), prices)


@query("SELECT DISTINCT 'ООО ' || p_brand || ' Pharma' AS name, CASE WHEN p_brand = 'Brand#3' THEN 'Other' ELSE p_brand END AS maker, CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE 100.0 END AS score, CASE WHEN p_brand = 'Brand#3' THEN 'MANUAL' ELSE 'AUTO' END AS how FROM part")
def q_maker_aliases(t: Tables) -> DataFrame:
    brands = t.part.select("p_brand").distinct()
    manual = t.spark.createDataFrame([("ООО Brand#3 Pharma", "Other")], "name string, maker string")
    return matching.discover_aliases(brands.select(F.concat(F.lit("ООО "), "p_brand", F.lit(" Pharma")).alias("name")), brands.select(F.col("p_brand").alias("maker")), manual)


@query(None)
def q_candidate_pool(t: Tables) -> DataFrame:
    """The best 20 items of each part, by name similarity; names have no SQL form, a test holds it against brute force."""
    return matching.pool(_products(t).checkpoint(), _items(t).checkpoint()).select("product", "item", "rank", "same_maker")


def _variants(t: Tables) -> DataFrame:
    """Every part as an item: in another spelling, some without a count, some with another form or maker."""
    k, n = F.col("p_partkey") % 5, F.upper("p_name")
    name = F.when(k == 0, F.concat(n, F.lit(" "), F.col("p_size"), F.lit(" MG таблетки"))).when(k == 1, F.concat(n, F.lit(" "), F.col("p_size"), F.lit("мг сироп №10"))).when(k == 2, F.concat(n, F.lit(" форте "), F.col("p_size"), F.lit("мг таб N10"))).otherwise(F.concat(n, F.lit(" "), F.col("p_size"), F.lit("мг таб N10")))
    maker = F.when(F.col("p_partkey") % 7 == 0, F.md5("p_type")).otherwise(F.md5("p_brand"))
    return matching.prepared(t.part.select((F.col("p_partkey") + 1000000).alias("item"), name.alias("name"), maker.alias("maker"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price")), "name", "maker").checkpoint()


@query(None)
def q_best_supplier(t: Tables) -> DataFrame:
    """Each part's best item by the decision cascade, or why it has none; name scores have no SQL form, a test holds them against a plain walk."""
    products, items = _products(t).checkpoint(), _variants(t)
    found = matching.best_of_alike(products, items)
    return found.select("product", "item", "score", "outcome", "candidates", "structure_rejects", "maker_rejects", "name_rejects", "weak_rejects", "suspicious")


@query(None)
def q_match_fuzzy(t: Tables) -> DataFrame:
    """Composite keys first, then names: each part and each item once, in the order of the parts."""
    products, items = _products(t).checkpoint(), _variants(t)
    return matching.cascade([("composite", matching.composite_classes(products, items)), matching.fuzzy_pass(products, items)], F.col("price"))


@query("WITH w AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 AS c, p_type AS f, list_distinct(string_split(p_name, ' ')) AS t FROM part), x AS (SELECT a.k AS product, b.k AS item, 3 * len(list_intersect(a.t, b.t)) + 2 + CASE WHEN a.c > 0 AND a.c = b.c THEN 2 ELSE 0 END + 2 AS score FROM w AS a JOIN w AS b ON a.f = b.f AND (a.s = b.s OR a.s = b.s + 1) AND (a.c = 0 OR b.c = 0 OR a.c = b.c) WHERE len(list_intersect(a.t, b.t)) > 0) SELECT product, item, score, row_number() OVER (PARTITION BY product ORDER BY score DESC, item) AS rank FROM x WHERE score >= 5 QUALIFY rank <= 500")
def q_signature_candidates(t: Tables) -> DataFrame:
    """Parts that share a word of the name; sizes are doses, types forms."""
    k, size = F.col("p_partkey"), F.col("p_size")
    count, words, none = F.when(k % 3 > 0, k % 3).cast("int"), F.split("p_name", " "), F.array().cast("array<string>")
    wanted = t.part.select(k.alias("product"), words.alias("brand"), F.array(size.cast("string")).alias("dosage"), count.alias("count"), F.array("p_type").alias("forms"), none.alias("volume"))
    offered = t.part.select(k.alias("item"), words.alias("tokens"), F.array(size.cast("string"), (size + 1).cast("string")).alias("dosage"), count.alias("count"), F.array("p_type").alias("forms"), none.alias("volume"))
    return matching.signature_candidates(wanted, offered)


@query(None)
def q_item_candidates(t: Tables) -> DataFrame:
    """Each item's product, how sure that is and who comes second; a test holds it against a plain walk."""
    return matching.item_candidates(_variants(t), _products(t).checkpoint())


@query(None)
def q_match_audit(t: Tables) -> DataFrame:
    """How many parts found an item, or why not; with the sums of what their candidates fell to."""
    products, items = _products(t).checkpoint(), _variants(t)
    firsts, members = matching.alike(products, "product", "base", "maker_key", "struct")
    firsts = firsts.checkpoint()
    return matching.audit(firsts, items, matching.judged(matching.pool(firsts, items), firsts, items).checkpoint(), members=members)["summary"]
