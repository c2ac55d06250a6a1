"""Readers, scalars, linkage and delivery."""

import difflib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pricewright.functions import dates, makers, numbers, text
from pricewright.operators import dedup, feed_rows, linkage, matching, structure
from pricewright.sinks import exports
from pricewright.sources import feeds
from pricewright.streaming import snapshots

SCHEMA = StructType([StructField("id", LongType()), StructField("price", DoubleType()), StructField("goods", StructType([StructField("fullName", StringType())]))])
ROWS = [{"id": 1, "price": 2.5, "goods": {"fullName": "A"}}, {"id": 2, "price": None, "goods": None}]


@pytest.mark.parametrize(("name", "body", "kind"), [
    ("a.txt", json.dumps(ROWS), "json"), ("b.txt", json.dumps({"items": ROWS}), "json"), ("c.txt", "\n".join(map(json.dumps, ROWS)) + "\n\nnot json\n", "ndjson"), ("d.jsonl", "\n".join(map(json.dumps, ROWS)), "ndjson"),
])
def test_json_feeds(spark, tmp_path, name, body, kind):
    p = tmp_path / name
    p.write_text(body)
    assert feeds.sniff(spark, str(p)) == kind
    assert sorted(r.id for r in feeds.read_feed(spark, str(p), SCHEMA).collect()) == [1, 2]


def test_csv_in_cp1251_with_semicolons(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("артикул;цена\n000123;12,50\n".encode("cp1251"))
    r = feeds.read_feed(spark, str(p), SCHEMA).first()
    assert r["артикул"] == "000123" and r["цена"] == "12,50"


def test_csv_with_cyrillic_after_the_sample(spark, tmp_path):
    for encoding in ("cp1251", "utf-8", "utf-8-sig"):
        p = tmp_path / f"{encoding}.csv"
        p.write_bytes(("sku;name\n" + "000123;ascii only\n" * 2000 + "000124;Анальгин №20\n").encode(encoding))
        rows = feeds.read_feed(spark, str(p), SCHEMA)
        assert rows.columns == ["sku", "name"] and rows.count() == 2001
        assert rows.where("sku = '000124'").first().name == "Анальгин №20"


def test_csv_delimiter_of_the_sample(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("sku;name, form, dose, pack\n" + "".join(f"{i};a;b\n" for i in range(20)))
    assert feeds.read_feed(spark, str(p), SCHEMA).columns == ["sku", "name, form, dose, pack"]


def test_workbook(spark, tmp_path):
    p = tmp_path / "x.xlsx"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>SKU</t></si><si><t>price</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>X1</t></is></c><c r="C3"><v>5.5</v></c></row></sheetData></worksheet>')
    r = feeds.read_feed(spark, str(p), SCHEMA).first()
    assert (r.sheet, r["_row"], r.cells["SKU"], r.cells["price"]) == ("S", 3, "X1", "5.5")


def test_html_helpers(spark):
    html = '<table><tr><td>a</td><th>b</th></tr></table><input type="hidden" name="k" value="v"><a href="?page=3">3</a>'
    d = spark.createDataFrame([(html,)], "h string")
    r = d.select(feeds.html_cells(F.get(feeds.html_rows(F.col("h")), F.lit(0))).alias("c"), feeds.hidden_inputs(F.col("h")).alias("m"), feeds.max_page(F.col("h")).alias("p")).first()
    assert (r.c, r.m, r.p) == (["a", "b"], {"k": "v"}, 3)


def one(spark, c, *values):
    return spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values)))).select(c.alias("x")).first().x


@pytest.mark.parametrize(("c", "value", "want"), [
    (lambda: text.sku18(F.col("v0")), "a_b_123", "000000000000000123"), (lambda: text.sku18(F.col("v0")), "abc", None), (lambda: text.composite_sku(F.col("v0")), "1_2_3", "1_2_3"), (lambda: text.composite_sku(F.col("v0")), "1__3", None),
    (lambda: text.text_key(F.col("v0")), "  Ёлка-2!  5%", "елка-2 5%"), (lambda: text.barcode(F.col("v0")), "12-34-56", "123456"), (lambda: text.barcode(F.col("v0")), "12", ""), (lambda: text.safe_cell(F.col("v0")), "=1+1", "'=1+1"), (lambda: text.sku_loose(F.col("v0")), "000", "0"),
    (lambda: text.pack_count(F.col("v0")), "таб №20", 20), (lambda: text.column_title(F.col("v0")), "A — a — B", "A — B"), (lambda: text.strip_tags(F.col("v0")), "<p>a&nbsp;<b>b</b></p>", "a b"),
    (lambda: dates.expiry(F.col("v0")), "2027-01-31T00:00:00Z", "2027-01-31"), (lambda: dates.expiry(F.col("v0")), "0001-01-01T00:00:00", ""), (lambda: numbers.tolerant_decimal(F.col("v0"), "double"), "1 234,50 тг", 1234.5), (lambda: numbers.tolerant_decimal(F.col("v0"), "double"), "1.234,5", 1234.5),
    (lambda: numbers.percent_points(F.col("v0")).cast("double"), "5,5", 5.5), (lambda: numbers.percent_points(F.col("v0")).cast("double"), "0.055", 5.5), (lambda: numbers.flag(F.col("v0")), "Да", True),
])
def test_scalars(spark, c, value, want):
    assert one(spark, c(), value) == want


@pytest.mark.parametrize(("a", "b", "want"), [
    ("Ибуфен 100мг/5мл 100мл сусп", "Ибуфен 0,1/5 МЛ 100,0 СУСП", None), ("Ибуфен 100мг/5мл 100мл сусп", "Ибуфен 0,1/5 МЛ 120МЛ СУСП", "volume_conflict"),
    ("Цефтриаксон 1г амп N1", "Цефтриаксон 1г пор д/ин амп N1", None), ("Тест 100мг таб N10", "Тест 100мг сироп 100мл", "form_conflict"),
])
def test_structures(spark, a, b, want):
    assert one(spark, structure.mismatch(structure.structure(F.col("v0")), structure.structure(F.col("v1"))), a, b) == want


def test_key_cascade_and_assignment(spark):
    items = spark.createDataFrame([(1, "g1", None), (2, None, "s2"), (3, "x", "y")], "i int, g string, s string")
    products = spark.createDataFrame([(10, "g1", "s2"), (9, "g1", None)], "id int, pg string, ps string")
    got = {r.i: (r.matched_id, r.match_kind) for r in linkage.key_cascade(items, products, [("g", "pg"), ("s", "ps")], "id").collect()}
    assert got == {1: (9, "g"), 2: (10, "s"), 3: (None, None)}
    scored = spark.createDataFrame([(1, 7, 90.0), (1, 8, 80.0), (2, 7, 95.0), (2, 8, 70.0), (3, None, 1.0)], "p int, i int, score double")
    assert sorted((r.p, r.i) for r in linkage.assign_in_order(scored, "p", "i", -F.col("score")).collect()) == [(1, 7), (2, 8)]
    assert linkage.similarity("alpha beta", "beta alpha") == 100 and linkage.partial_ratio("abc", "xxabcxx") == 100
    assert linkage.token_set_ratio("a b", "b a c") == 100 and linkage.token_set_ratio("a b", "a c") == 100 * difflib.SequenceMatcher(None, "a b", "a c").ratio()


def walked(pairs):
    """The plain walk: products in order, each takes its best free item."""
    used, want = set(), []
    for p in sorted({p for p, _, _ in pairs}):
        own = sorted((c, i) for q, i, c in pairs if q == p and i not in used)
        if own:
            used.add(own[0][1])
            want.append((p, own[0][1]))
    return want


@pytest.mark.parametrize("walk", [2_000_000, 40])
@pytest.mark.parametrize("kind", ["any", "same wish", "chain", "few items"])
def test_assignment_equals_a_walk_in_order(spark, monkeypatch, walk, kind):
    rng = random.Random(4)
    pairs = {
        "any": [(p, i, rng.randint(0, 5)) for p in range(60) for i in range(40) if rng.random() < 0.2],
        "same wish": [(p, i, i) for p in range(14) for i in range(14)],
        "chain": [(p, i, p - i) for p in range(60) for i in (p - 1, p) if i >= 0],
        "few items": [(p, i, (p * i) % 5) for p in range(30) for i in range(4)],
    }[kind]
    monkeypatch.setattr(linkage, "WALK", walk)
    got = linkage.assign_in_order(spark.createDataFrame(pairs, "p int, i int, cost int").repartition(3), "p", "i", F.col("cost"))
    assert sorted((r.p, r.i) for r in got.collect()) == walked(pairs) and got.columns == ["p", "i", "cost"]


def test_assignment_of_a_block_of_thousands_and_of_nothing(spark):
    """2,000 products want the same 2,000 items in the same order: 4 million pairs, no round per product."""
    block = spark.range(2000).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("i"))
    got = linkage.assign_in_order(block, "p", "i", F.col("i"))
    assert got.where("p = i").count() == 2000 == got.count()
    assert linkage.assign_in_order(spark.createDataFrame([], "p int, i int, cost int"), "p", "i", F.col("cost")).count() == 0


def test_most_similar_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample(["red", "ring", "bolt", "blue", "nut"], 2)), f"k{i % 3}") for i in range(40)] + [(99, "alone", "k9")]
    got = {r.i: (r.other, r.score) for r in linkage.most_similar(spark.createDataFrame(rows, "i int, n string, k string"), "i", "n", "k").collect()}
    for i, n, k in rows:
        best = min(((-linkage.similarity(n, m), j) for j, m, l in rows if l == k and j != i), default=None)
        assert got.get(i) == (best and (best[1], -best[0]))


def test_candidate_pool_and_ratios_equal_brute_force(spark):
    rng = random.Random(5)
    names = [f"{rng.choice(['alfa', 'alfa beta', 'gamma', 'alpha'])} {rng.choice(['forte', 'neo', ''])}".strip() + f" {rng.choice([5, 10])}мг" for _ in range(40)]
    makers_ = [rng.choice(["m1", "m2", ""]) for _ in names]
    rows = spark.createDataFrame([(k, n, m, float(rng.randint(1, 9))) for k, (n, m) in enumerate(zip(names, makers_))], "product int, name string, maker string, price double")
    x = matching.prepared(rows, "name", "maker")
    got = {}
    for r in matching.pool(x, x.withColumnRenamed("product", "item"), 5).collect():
        got.setdefault(r.product, []).append((r["rank"], r.item))
    kept = {r.product: (r.base, r.struct.dosage, r.maker_key, r.price) for r in x.collect()}
    for p, (base, dose, maker, _) in kept.items():
        found = []
        for i, (b, d, m, price) in kept.items():
            near = base == b or base.split(" ")[0] == b.split(" ")[0] or base[:5] == b[:5] or maker == m != ""
            score = linkage.base_similarity(base, b)
            if near and dose == d and (maker == m or "" in (maker, m) or score >= 90):
                found.append((maker != m, -score, price, i))
        assert sorted(got.get(p, [])) == [(k + 1, f[-1]) for k, f in enumerate(sorted(found)[:5])]
    pair = spark.createDataFrame([("BRAND", "BRANDT"), ("", "A"), ("X", "X"), (None, "X")], "a string, b string")
    assert [r.r for r in pair.select(makers.ratio("a", "b").alias("r")).collect()] == [10 / 11, 0.0, 1.0, 0.0]


def test_feed_rows_of_the_fixture(spark, tmp_path):
    goods = "goods struct<id: bigint, fullName: string, number: string, producer: string, price: double>"
    rows = [
        (1, 5, "11885.77", None, 42.0, "emit-sku-1", "ООО Лек", (9, "Препарат", "N10", "x", None)), (2, 5, None, None, 1.0, "s", "m", (9, "A", None, None, None)), (3, 5, "0", 10.0, 1.0, "s", "m", (9, "A", None, None, None)),
        (4, 5, "7", None, 1.0, "s", "m", (9, " ", None, None, None)), (5, None, None, 3.0, 1.0, "", "m", (9, "B 100 тг", None, None, 4.0)), (6, None, "5", None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, f"id bigint, goodsId bigint, goodsPrice string, goodsPriceWithUserDiscount double, stored double, distributorGoodsId string, distributorProducer string, {goods}")
    got = {r.source_item_id: r for r in feed_rows.normalize(raw, F.lit(8), F.lit("f"), makers.alias_array({"ЛЕК": "LEK"})).collect()}
    assert [got[i].skip_reason for i in range(1, 7)] == [None, "missing_price", "invalid_price", "missing_name", None, "missing_name"]
    first = got[1]
    assert (first.price, first.manufacturer, first.variant_key, first.pack_signature, first.stock, first.filial_id) == (11885.77, "LEK", "sku:emit-sku-1", "number:n10", 42.0, 8)
    assert (got[5].goods_id, got[5].name_key, got[5].price) == (9, "b", 3.0)
    exports.write_csv(feed_rows.flatten(raw, columns=feed_rows.SHORT).coalesce(1), str(tmp_path / "out"))
    text_ = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text_.startswith("\ufeffgoods_id;filial_id;") and len(text_.splitlines()) == 7


def test_dedup_and_guards(spark, tmp_path):
    r = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 1.0)], "k string, n int, v double")
    assert {x.k: x.v for x in dedup.best_per_key(r, ["k"], F.desc("v"), F.asc("n")).collect()} == {"a": 7.0, "b": 1.0}
    assert {x.k: x.n for x in dedup.max_per_key(r, ["k"], F.col("v")).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="below"):
        dedup.publish(r, str(tmp_path / "t"), "k", None)
    assert dedup.publish(r, str(tmp_path / "t"), "k", 4, least=1) == 3
    dedup.publish(r.where("k = 'a'").limit(1), str(tmp_path / "t"), "k", None, least=1)
    assert {x.k: x.n for x in spark.read.parquet(str(tmp_path / "t")).groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 1}


def test_delivery_replays_as_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"source_key": "x", "v": 1}\n{"source_key": "y", "v": 2}\n')
    go = lambda: snapshots.deliver(spark, str(tmp_path / "in"), StructType.fromDDL("source_key string, v int"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("v", F.col("v") * 10)).awaitTermination()
    go()
    (tmp_path / "in" / "2.json").write_text('{"source_key": "x", "v": 3}\n')
    go()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.source_key: r.v for r in out.collect()} == {"x": 30, "y": 20}
    assert snapshots.fingerprint(out, ["v"]) == snapshots.fingerprint(out.orderBy("v"), ["v"])
