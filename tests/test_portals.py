"""Portal pages, imports of contractors and reference files, small changes of lists."""

from decimal import Decimal

from pyspark.sql import functions as F

from pricewright.functions import makers
from pricewright.operators import contractors, lists, references
from pricewright.sources import html_lists


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_directory_keeps_the_first_link_of_an_id(spark):
    page = """<TABLE><tr><th>x</th></tr><tr><td title="c7">
      <a href="https://h/price/see/12">А &amp; Б</a><i class="glyphicon-eye-open"></i></td><td>1.2</td><td></td><td></td><td></td><td></td><td>+7</td><td> <b>Алматы</b></td></tr>
      <tr><td><a href='/price/see/12'>later</a></td></tr><tr><td><a href=price/see/5 ></a><span id="supplier_name_5"> <b>Имя</b></span></td></tr><tr><td><a href="/price/see/x">no</a></td></tr></TABLE>"""
    d = spark.createDataFrame([(1, page), (2, "<tr><td><a href='price/see/5'>other page</a><a class='glyphicon-eye-close'></a></td></tr>"), (3, None), (4, "")], "page int, html string")
    assert got(html_lists.price_directory(d), "id") == [(5, "Имя", None, "", "", "", ""), (12, "А & Б", True, "c7", "1.2", "+7", "Алматы")]


def test_last_page_of_all_encodings(spark):
    pages = ["paginationSet(7) paginationSet(12)", "pageCurrent = '9'", '<a data-page="4">', "<div class='pager'><a>1</a><a> 31 </a>x</div><p>99</p>", '<input id="pageCurrent" value="8">', "nothing", "", "data-page=99999999999999"]
    d = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, html string")
    assert [r[0] for r in d.orderBy("i").select(html_lists.last_page(F.col("html"))).collect()] == [12, 9, 4, 31, 8, 1, 1, 1, 1]


def test_items_by_header_by_place_and_their_common_shape(spark):
    named = "<tr><th>№</th><th>Старая цена</th><th>Цена</th><th>Товар</th><th>Производитель</th><th>Срок</th><th>Кол. в уп</th><th>Остаток</th></tr><tr><td>1</td><td>9</td><td>1&nbsp;234,50 ₸</td><td> <b>Анальгин</b> &lt;N10&gt;</td><td>– Bayer</td><td>2025</td><td>10</td><td>&gt;5</td></tr><tr><td>2</td></tr><tr><td>3</td><td></td><td></td><td>без цены</td></tr>"
    placed = "<tr>" + "".join(f"<td>{c}</td>" for c in "abcdefgh") + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in ("1", "Имя", "М", "", "1.2.3", "", "3", "-")) + "</tr>"
    d = spark.createDataFrame([(1, named), (2, placed), (3, "<tr><td>head alone</td></tr>"), (4, None)], "list_id int, html string")
    x = html_lists.price_items(d)
    assert got(x.select("list_id", "row_no", "name", "manufacturer", "expiry", "price", "pack", "min_order", "stock", "price_header", F.size("missing")), "list_id", "row_no") == [
        (1, 1, "Анальгин <N10>", "Bayer", "2025", Decimal("1234.5"), 10, None, 5, "цена", 0), (1, 3, "без цены", "", None, None, None, None, None, "цена", 0), (2, 1, "Имя", "М", None, None, None, 3, None, "e", 4),
    ]
    l = spark.createDataFrame([(1, "L1", "D"), (2, "L2", None)], "list_id int, list_name string, distributor string")
    u = html_lists.unified_items(x, l, "widman", makers.alias_array({"Bayer": "BAYER AG"}))
    assert got(u.select("list_id", "product_name", "manufacturer", "pack_quantity", F.get_json_object("raw", "$.minOrder")), "list_id", "product_name")[2] == (2, "Имя", "М", 3, "3.0000")
    assert u.where("list_id = 1 AND product_name LIKE 'Анальгин%'").first()["distributor_price"] == Decimal("1234.5")


def test_contractors_keep_what_is_known(spark):
    rows = [(2, "F1", "late", "H2", "P", "d1"), (1, "F1", "B", None, "P", "d1"), (3, " ", "B", "H", "P", ""), (4, "F0", "own", "H1", "P", None), (5, "F1", "", "H9", "", " "), (6, "F1", "", "H9", None, None)]
    d = spark.createDataFrame(rows, "_row int, format string, branch string, holding string, party string, point string")
    x = contractors.load(d, {"formats": spark.createDataFrame([("F0", "A")], contractors.SCHEMAS["formats"]), "links": spark.createDataFrame([("F0", "P", "A", "", "was")], contractors.SCHEMAS["links"])})
    assert got(x["formats"], "format") == [("F0", "A"), ("F1", "B")]
    assert got(x["holdings"], "holding") == [("H1", "A"), ("H2", "B"), ("H9", "B"), (contractors.NO_HOLDING, "B")]
    assert got(x["parties"], "party", "branch") == [("P", "A", "H1"), ("P", "B", contractors.NO_HOLDING), (contractors.NO_PARTY, "B", "H9")]
    assert got(x["points"], "point") == [("d1", "P", "B")]
    assert got(x["links"], "format", "party", "point") == [("F0", "P", "A", "", "was"), ("F1", "P", "B", "d1", contractors.NO_HOLDING), ("F1", contractors.NO_PARTY, "B", "", "H9")]
    assert all(r.n == 0 for r in contractors.orphans(x).collect())
    again = contractors.load(d, x)
    assert all(again[k].count() == x[k].count() for k in x)
    none = contractors.load(d.where("false"), {})
    assert all(v.count() == 0 for v in none.values())


def test_reference_files_are_judged_one_by_one(spark):
    s = "file int, data_type string, row int, sku string, value string, name string"
    rows = [(1, "stock", 1, "a", "5", None), (1, "stock", 2, "a", "6", None), (2, "stock", 1, "a", "9", None), (2, "stock", 2, " ", "9", None), (3, "rating_local", 1, "a", "0", None), (3, "rating_local", 2, "a", "3", None), (3, "rating_local", 3, "a", "4", None), (3, "rating_local", 4, "zz", "1", None), (4, "holdings", 1, None, None, " "), (4, "holdings", 2, None, None, "H")]
    files = spark.createDataFrame([(1, "stock", ["sku", "stock"]), (2, "stock", ["sku", "stock"]), (3, "rating_local", ["sku", "rank"]), (4, "holdings", ["name"]), (5, "cost", ["sku", "cost"])], "file int, data_type string, headers array<string>")
    r = references.judged(spark.createDataFrame(rows, s), spark.createDataFrame([("a",)], "sku string"))
    assert [x[0] for x in got(r.select("fault", "file", "row"), "file", "row")] == [None, None, None, "empty SKU", "bad rank", None, "repeated SKU", "unknown SKU", "empty name", None]
    done = references.jobs(files, r)
    assert got(done.select("file", "total", "good", "failed", "status"), "file") == [(1, 2, 2, 0, "success"), (2, 2, 1, 1, "partial"), (3, 4, 1, 3, "partial"), (4, 2, 1, 1, "partial"), (5, 0, 0, 0, "success")]
    assert tuple(references.batch_status(done).first()) == ("partial", 5, 2, 3, 0)
    old = spark.createDataFrame([("stock", "x", "b", "1"), ("stock", "y", "b", "1"), ("cost", "x", "b", "1"), ("rating_local", "x", "a", "9"), ("rating_local", "x", "b", "8")], "data_type string, branch string, sku string, value string")
    sent = spark.createDataFrame([(i, "x") for i in range(1, 6)], "file int, branch string")
    # the stock of x is anew, its cost is emptied by a file without rows, that of y stays
    assert got(references.applied(old, r, done, sent), "data_type", "branch", "sku") == [("rating_local", "x", "a", "3"), ("rating_local", "x", "b", "8"), ("stock", "x", "a", "6"), ("stock", "y", "b", "1")]


def test_checks_find_their_list_by_account_and_rename_it(spark):
    t = "timestamp'2024-01-0{}'"
    known = spark.sql("SELECT * FROM VALUES (1, 'provisor', 'old', 'acc', '7', 'u', {0}, NULL, {0}, 's', 'm'), (2, 'emit', 'k', '', '', 'u', {0}, NULL, NULL, 's', 'm'), (3, 'emit', 'k', '', '', 'u', {1}, NULL, {0}, 's', 'm') AS t(list_id, source_type, source_key, account, external_id, source_updated_at, updated_at, checked_at, success_at, status, message)".format(t.format(1), t.format(2)))
    checks = spark.sql("SELECT * FROM VALUES ('provisor', 'new', ' acc', '7', 'v', {0}, 'updated', NULL), ('emit', 'k', '', '', '', {0}, 'updated', 'x'), ('emit', 'k', '', '', '', {1}, 'failed', 'y'), ('emit', 'nowhere', 'acc', '7', '', {1}, 'failed', 'y') AS t(source_type, source_key, account, external_id, source_updated_at, checked_at, status, message)".format(t.format(3), t.format(4)))
    x = lists.mark_checked(known, checks)
    day = lambda c: F.dayofmonth(c)
    assert got(x.select("list_id", "source_key", "source_updated_at", day("checked_at"), day("success_at"), "status", "message"), "list_id") == [(1, "new", "v", 3, 3, "updated", ""), (2, "k", "u", None, None, "s", "m"), (3, "k", "u", 4, 1, "failed", "y")]
