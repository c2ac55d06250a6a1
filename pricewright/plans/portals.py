"""Lists shown as web pages, workbooks for spreadsheets, and imports of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..operators import contractors, lists, references
from ..session import scratch
from ..sinks import exports, workbooks
from ..sources import feeds, html_lists
from .catalog import query
from .tables import Tables, sql


def _pages(rows: DataFrame, number: str, tr, head: str = "", tail: str = "") -> DataFrame:
    """Pages of fifty rows."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), tr.alias("tr")))), lambda x: x["tr"]), "\n")
    return rows.groupBy(F.floor(F.col(number) / 50).cast("long").alias("page")).agg(F.concat(F.lit(f"<table>{head}"), body, F.lit(f"</table>{tail}")).alias("html"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'Widman ' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'ТОО & ' || s_name ELSE s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS enabled, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_nationkey ELSE '' END AS counterpart, '01.02.2024 10:0' || s_nationkey % 10 AS updated_at, CAST(s_suppkey AS VARCHAR) AS phone, 'Город ' || s_nationkey AS city FROM supplier")
def q_price_directory(t: Tables) -> DataFrame:
    """Suppliers as a portal's lists, each linked to again from the next page under another name."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.when(k % 7 == 0, " &nbsp; ").when(k % 3 == 0, F.concat(F.lit("<i>ТОО</i> &amp;\n"), F.col("s_name"))).otherwise(F.col("s_name"))
    eye = F.when(k % 3 == 0, "<i class='glyphicon glyphicon-eye-open'></i>").when(k % 3 == 1, "<i class=glyphicon-eye-close>").otherwise("")
    link = F.concat(F.lit('<a class="x" href="/price/see/'), k, F.lit('">'))
    shown = F.when(k % 3 == 0, F.concat(link, F.lit("list</a><span id='supplier_name_"), k, F.lit("'>"), name, F.lit("</span>"))).otherwise(F.concat(link, name, F.lit("</a>")))
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    title = F.when(k % 2 == 0, F.concat(F.lit('<td title="c'), nation, F.lit('">'))).otherwise("<td>")
    row = F.concat(F.lit("<tr>"), title, shown, eye, F.lit("</td>"), td(F.concat(F.lit("<b>01.02.2024</b> 10:0"), nation % 10)), F.lit("<td></td>" * 4), td(k), td(F.concat(F.lit("Город "), nation)), F.lit("</tr>"))
    again = F.concat(F.lit("<tr><td>"), link, F.lit("again</a></td></tr><tr><td>no link</td></tr>"))
    first = _pages(t.supplier, "s_suppkey", row)
    return html_lists.price_directory(first.unionByName(_pages(t.supplier, "s_suppkey", again).withColumn("page", F.col("page") + 1_000_000_000)))


@query("SELECT p_partkey // 50 AS page, p_partkey % 50 + 1 AS row_no, p_name AS name, CASE WHEN p_partkey // 50 % 3 = 1 THEN '' ELSE p_brand END AS manufacturer, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price, CAST(p_size AS DOUBLE) AS stock, CASE WHEN p_partkey // 50 % 3 = 1 THEN 'manufacturer' WHEN p_partkey // 50 % 3 = 2 THEN 'name,manufacturer,price,stock' ELSE '' END AS missing, 1 + p_partkey // 50 % 12 AS pages FROM part")
def q_html_price_items(t: Tables) -> DataFrame:
    """Parts as portal tables: with all headers, in another order beside an old price, and with unknown ones."""
    k, kind = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50) % 3
    td = lambda *cs: F.concat(*[x for c in cs for x in (F.lit("<td>"), c, F.lit("</td>"))])
    price = F.when(k % 9 == 0, "-").otherwise(F.concat(F.regexp_replace(F.translate(F.format_number("p_retailprice", 2), ",.", " ,"), " ", "&nbsp;"), F.lit(" тг")))
    name, brand, size = F.col("p_name"), F.concat(F.lit(" – "), F.col("p_brand")), F.col("p_size").cast("string")
    row = F.when(kind == 0, td(name, brand, price, size)).when(kind == 1, td(size, F.lit("1"), price, name)).otherwise(td(F.lit("1"), name, brand, F.lit(""), price, F.lit("1"), F.lit("2"), size))
    pages = _pages(t.part, "p_partkey", F.concat(F.lit("<tr>"), row, F.lit("</tr>")))
    heads = ("Наименование|Производитель|Цена, тг|Остаток", "Остаток|Старая цена|Цена с НДС|Товар", "a|b|c|d|e|f|g|h")
    head = F.get(F.array(*[F.lit("<tr>" + "".join(f"<th> {h}</th>" for h in hs.split("|")) + "</tr>") for hs in heads]), (F.col("page") % 3).cast("int"))
    bar = F.concat(F.lit("<ul class='pagination'><li><a>"), 1 + F.col("page") % 12, F.lit("</a></li><li>1</li></ul>"))
    pages = pages.withColumn("html", F.concat(F.lit("<table>"), head, F.expr("substring(html, 8)"), bar)).withColumn("pages", html_lists.last_page(F.col("html")))
    x = html_lists.price_items(pages)
    return x.select("page", "row_no", "name", "manufacturer", F.col("price").cast("double").alias("price"), F.col("stock").cast("double").alias("stock"), F.array_join("missing", ",").alias("missing"), "pages")


@query("SELECT o_orderpriority AS list, o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders")
def q_workbooks(t: Tables) -> DataFrame:
    """A workbook per priority, of at most 5,000 rows; read back, each order stands at its place."""
    at, rows_per_book = f"{scratch(t.spark, 'workbooks')}", 5000
    x = t.orders.select(F.col("o_orderpriority").alias("list"), F.col("o_orderkey").alias("number"), F.to_date("o_orderdate").alias("day"), F.round("o_totalprice", 2).alias("price"))
    workbooks.write(t.spark, {"Прайс": workbooks.Sheet(x, [F.col("number")], ("price", 1, 100)), "other": workbooks.Sheet(x.where("false").select("list", "price"), [])}, at, "list", rows_per_book)
    name = F.element_at(F.split(F.regexp_replace(F.url_decode("file"), r"\.xlsx$", ""), "/"), -1)
    back = feeds.read_xlsx(t.spark, f"{at}/*.xlsx").withColumn("name", name)
    book = F.coalesce(F.nullif(F.regexp_extract("name", r"-(\d{3,})$", 1), F.lit("")).cast("int"), F.lit(1))
    cell = lambda k: F.col("cells")[k]
    return back.select(
        F.regexp_replace("name", r"-\d{3,}$", "").alias("list"), cell("number").cast("long").alias("number"), dates.cell_date(cell("day")).cast("string").alias("day"), cell("price").cast("double").alias("price"),
        ((book - 1) * rows_per_book + F.col("_row") - 1).cast("long").alias("place"),
    )


@query(sql("products", "offers", "regional") + ", w AS (SELECT product, min(cents) FILTER (region = 0) AS a, min(cents) FILTER (region = 1) AS b FROM regional GROUP BY product) SELECT product, cost, a, b, round(cost * 1.25) AS price, CASE WHEN product % 2 = 0 THEN 'priced; rank ' || product % 5 ELSE 'priced' END AS log FROM products LEFT JOIN w USING (product) WHERE product % 4 > 0")
def q_price_list_export(t: Tables) -> DataFrame:
    """Products that a run has priced, with a column per region and what the run says about each."""
    k = F.col("product")
    run = t.products.where(k % 4 > 0).select("product", F.round(F.col("cost") * 1.25).alias("price"), F.array(F.lit("priced"), F.lit(""), F.when(k % 2 == 0, F.concat(F.lit("rank "), k % 5))).alias("log"))
    rivals = t.regional.where("region < 2").select("product", F.when(F.col("region") == 0, "a").otherwise("b").alias("title"), "cents")
    return exports.priced_rows(exports.wide(t.products.select("product", "cost"), rivals, "product", ["a", "b"], "cents"), run, "product")


@query("WITH x AS (SELECT c_custkey k, 'F' || c_nationkey AS format, 'B' || c_custkey % 4 AS own, CASE WHEN c_custkey % 5 = 0 THEN 'Без холдинга' ELSE c_mktsegment END AS h, CASE WHEN c_custkey % 50 = 0 THEN 'Не указан' ELSE 'P' || c_custkey % 50 END AS party, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'D' || c_custkey % 7 END AS point FROM customer WHERE c_custkey % 17 > 0), f AS (SELECT format, CASE WHEN CAST(substr(format, 2) AS INT) < 10 THEN 'R' ELSE arg_min(own, k) END AS branch FROM x GROUP BY format), y AS (SELECT * FROM x JOIN f USING (format)), l AS (SELECT format, party, branch, point, arg_min(h, k) AS holding FROM y GROUP BY format, party, branch, point), p AS (SELECT party, branch, arg_min(h, k) AS party_holding FROM y GROUP BY party, branch) SELECT l.*, party_holding FROM l JOIN p USING (party, branch)")
def q_contractors_import(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("_row"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("F"), "c_nationkey")).alias("format"), F.concat(F.lit(" B"), k % 4).alias("branch"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("holding"),
        F.when(k % 50 > 0, F.concat(F.lit("P"), k % 50)).otherwise("").alias("party"), F.when(k % 3 > 0, F.concat(F.lit("D"), k % 7)).alias("point"),
    )
    known = t.nation.where("n_nationkey < 10").select(F.concat(F.lit("F"), "n_nationkey").alias("format"), F.lit("R").alias("branch"))
    x = contractors.load(rows, {"formats": known})
    return x["links"].join(x["parties"].withColumnRenamed("holding", "party_holding"), ["party", "branch"])


_FILES = "x AS (SELECT o_orderkey % 6 AS file, CASE o_orderkey % 6 WHEN 0 THEN 'stock' WHEN 3 THEN 'stock' WHEN 1 THEN 'cost' WHEN 4 THEN 'cost' WHEN 2 THEN 'rating_global' ELSE 'other' END AS data_type, o_orderkey AS row, CASE WHEN o_orderkey % 6 = 3 AND o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS sku, o_orderkey % 100 AS value FROM orders), r AS (SELECT file, sku, min(row) AS first FROM x WHERE file = 2 AND value > 0 AND sku <> '' GROUP BY ALL), y AS (SELECT x.*, CASE WHEN file = 2 AND value = 0 THEN TRUE WHEN file = 2 AND r.first < row THEN TRUE WHEN file = 2 AND CAST(x.sku AS BIGINT) % 10 = 0 THEN TRUE WHEN x.sku = '' THEN TRUE ELSE FALSE END AS bad FROM x LEFT JOIN r USING (file, sku))"


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("stock", "cost", "rating_global", "stock", "cost", "other"))), (k % 6).cast("int"))
    rows = t.orders.select((k % 6).alias("file"), kind.alias("data_type"), k.alias("row"), F.when((k % 6 == 3) & (k % 7 == 0), " ").otherwise(F.col("o_custkey").cast("string")).alias("sku"), (k % 100).cast("string").alias("value"), F.lit(None).cast("string").alias("name"))
    files = rows.select("file", "data_type").distinct().withColumn("headers", F.when(F.col("file") == 4, F.array(F.lit("sku"))).otherwise(F.array(F.lit("sku"), F.lit("stock"), F.lit("cost"), F.lit("rank"))))
    rows = references.judged(rows, t.customer.where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("sku")))
    return rows, references.jobs(files, rows)


@query("WITH " + _FILES + " SELECT file, data_type, CASE WHEN file > 3 THEN 0 ELSE count(*) END AS total, CASE WHEN file > 3 THEN 0 ELSE count(*) FILTER (NOT bad) END AS good, CASE WHEN file > 3 THEN 0 ELSE count(*) FILTER (bad) END AS failed, CASE WHEN file > 3 THEN 'error' WHEN bool_or(bad) THEN 'partial' ELSE 'success' END AS status, CASE file WHEN 4 THEN 'missing columns: cost' WHEN 5 THEN 'unknown type' END AS error FROM y GROUP BY file, data_type")
def q_reference_jobs(t: Tables) -> DataFrame:
    """Orders as the rows of six reference files: one lacks a column, one is of no known type, two have bad rows."""
    return _batch(t)[1]


@query("WITH " + _FILES + ", b AS (SELECT unnest(['a', 'b']) AS branch), n AS (SELECT data_type, branch, sku, CAST(arg_max(value, row) AS VARCHAR) AS value FROM y, b WHERE NOT bad AND (file = 2 OR file < 2 AND branch = 'a') GROUP BY data_type, branch, sku), o AS (SELECT kind AS data_type, branch, CAST(c_custkey AS VARCHAR) AS sku, 'old' AS value FROM customer, b, (SELECT unnest(['stock', 'cost', 'rating_global']) AS kind)) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT (data_type <> 'rating_global' AND branch = 'a') AND (data_type, branch, sku) NOT IN (SELECT (data_type, branch, sku) FROM n)")
def q_reference_batch(t: Tables) -> DataFrame:
    """What the files leave: stock and cost of branch a anew, those of b as they were, ratings of both put in."""
    rows, done = _batch(t)
    both, kinds = F.explode(F.array(F.lit("a"), F.lit("b"))), F.array(F.lit("stock"), F.lit("cost"), F.lit("rating_global"))
    old = t.customer.select(both.alias("branch"), F.col("c_custkey").cast("string").alias("sku"), F.lit("old").alias("value")).withColumn("data_type", F.explode(kinds))
    sent = done.select("file", both.alias("branch")).where("branch = 'a' OR file IN (2, 3, 4)")
    return references.applied(old, rows, done, sent)


@query("WITH a AS (SELECT o_custkey, arg_max(o_orderkey % 5 / 2, (o_orderdate, o_orderkey)) AS c FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 NOT IN (0, 2) GROUP BY 1) SELECT c_custkey AS list_id, CASE WHEN c_custkey % 3 = 0 THEN 3.0 WHEN c_custkey % 4 = 0 THEN 4.0 WHEN c IS NOT NULL THEN c WHEN c_custkey % 3 = 1 THEN 1.0 END AS price_coefficient FROM customer LEFT JOIN a ON o_custkey = c_custkey")
def q_backfill_coefficients(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    given = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("list_id"), (F.col("o_orderkey") % 5 / 2).alias("coefficient"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") != "P").alias("is_active"))
    known = t.customer.select(k.alias("list_id"), F.when(k % 3 == 0, 3.0).when(k % 3 == 1, 1.0).alias("price_coefficient"), F.when(k % 4 == 0, 4.0).otherwise(F.when(k % 4 == 1, 1.0).when(k % 4 == 2, 0.0)).alias("coefficient"))
    return lists.backfill_coefficients(known, given).select("list_id", "price_coefficient")


@query("WITH o AS (SELECT o_custkey, arg_max(CASE o_orderkey % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'failed' ELSE 'checked_unchanged' END, (o_orderdate, o_orderkey)) AS status, strftime(max(o_orderdate), '%Y-%m-%d') AS checked FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1) SELECT c_custkey AS list_id, CASE WHEN status IS NOT NULL AND c_custkey % 2 = 0 THEN 'new ' || c_custkey ELSE 'k' || c_custkey END AS source_key, coalesce(status, 'none') AS status, checked, CASE WHEN status IN ('updated', 'checked_unchanged') THEN checked ELSE '2000-01-01' END AS success FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def q_mark_checked(t: Tables) -> DataFrame:
    """Orders as checks of customers' lists; those of even customers are known by account alone."""
    k, c = F.col("c_custkey"), F.col("o_custkey")
    old = F.lit("2000-01-01").cast("timestamp")
    known = t.customer.select(k.alias("list_id"), F.lit("provisor").alias("source_type"), F.concat(F.lit("k"), k).alias("source_key"), F.lit(" a").alias("account"), k.cast("string").alias("external_id"), F.lit("").alias("source_updated_at"), old.alias("updated_at"), F.lit(None).cast("timestamp").alias("checked_at"), old.alias("success_at"), F.lit("none").alias("status"), F.lit("").alias("message"))
    status = F.when(F.col("o_orderkey") % 3 == 0, "updated").when(F.col("o_orderkey") % 3 == 1, "failed").otherwise("checked_unchanged")
    newest = Window.partitionBy(c).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = t.orders.where(c % 5 > 0).withColumn("n", F.row_number().over(newest)).withColumn("at", F.to_timestamp("o_orderdate") - F.expr("make_interval(0, 0, 0, 0, 0, 0, n - 1)"))
    checks = last.select(F.lit("provisor").alias("source_type"), F.when(c % 2 == 0, F.concat(F.lit("new "), c)).otherwise(F.concat(F.lit("k"), c)).alias("source_key"), F.lit("a").alias("account"), c.cast("string").alias("external_id"), F.lit("").alias("source_updated_at"), F.col("at").alias("checked_at"), status.alias("status"), F.lit(None).cast("string").alias("message"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return lists.mark_checked(known, checks).select("list_id", "source_key", "status", day("checked_at").alias("checked"), day("success_at").alias("success"))


@query("WITH s AS (SELECT s_nationkey AS format_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS product, CASE WHEN s_suppkey % 2 = 0 THEN 'percentile:' || s_suppkey ELSE 'own' END AS source, 'old' AS supplier, 2.0 AS coefficient FROM supplier) SELECT * FROM s WHERE product IS NOT NULL OR source = 'own' OR format_id >= 20 UNION ALL SELECT s_nationkey, NULL, 'percentile:' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'percentile:' || s_suppkey ELSE s_name END, CASE WHEN s_suppkey % 11 = 0 THEN 1.0 ELSE 1.5 END FROM supplier WHERE s_nationkey < 20 AND s_suppkey % 5 > 0")
def q_percentile_settings(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    old = t.supplier.select(F.col("s_nationkey").alias("format_id"), F.when(k % 3 == 0, k).alias("product"), F.when(k % 2 == 0, F.concat(F.lit("percentile:"), k)).otherwise("own").alias("source"), F.lit("old").alias("supplier"), F.lit(2.0).alias("coefficient"))
    chosen = t.supplier.select(F.col("s_nationkey").alias("format_id"), k.cast("string").alias("id"), F.when(k % 7 > 0, F.col("s_name")).otherwise("").alias("name"), F.when(k % 11 == 0, "much").otherwise("1.5").alias("coefficient"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("enabled"))
    return lists.percentile_settings(old, chosen, t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("format_id")))
