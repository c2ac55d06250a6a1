"""Workbooks written and read back."""

import datetime
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pricewright.session import ship
from pricewright.sinks import workbooks
from pricewright.sinks.workbooks import Sheet
from pricewright.sources import feeds

SCHEMA = "k int, `№` int, name string, day date, share double, ok boolean"


def rows_of(spark, path):
    return sorted((os.path.basename(r.file), r.sheet_no, r._row, r.cells) for r in feeds.read_xlsx(spark, path).collect())


def test_typed_cells_and_texts_come_back(spark, tmp_path):
    ship(spark)
    rows = [(1, 2, "=1+1 <имя> &\n\tдва ", datetime.date(2024, 1, 2), 0.5, True), (1, 1, "\x01a" + "я" * 40000, None, float("nan"), False), (None, None, None, None, None, None), (1, 3, "", None, 1e20, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = workbooks.write(spark, {"Прайс & лист": Sheet(df, [F.col("№")], ("№", 1, 100)), "второй": Sheet(df.select("k", "name").where("k = 2"), [F.col("name")])}, f"file://{tmp_path}/a", "k")
    assert names == ["1.xlsx", "none.xlsx"] and sorted(n for n in os.listdir(tmp_path / "a") if n.endswith(".xlsx")) == names
    got = rows_of(spark, f"file://{tmp_path}/a/*.xlsx")
    # the row of nulls is blank and so isn't read
    assert got == [
        ("1.xlsx", 0, 2, {"№": "1", "name": "a" + "я" * 32765 + "…", "ok": "0"}),
        ("1.xlsx", 0, 3, {"№": "2", "name": "=1+1 <имя> &\n\tдва ", "day": "45293", "share": "0.5", "ok": "1"}),
        ("1.xlsx", 0, 4, {"№": "3", "name": "", "share": "1.0E20"}),
    ]
    with zipfile.ZipFile(tmp_path / "a" / "1.xlsx") as z:
        assert z.testzip() is None and len(z.namelist()) == 7
        assert 'sqref="A2:A4"' in z.read("xl/worksheets/sheet1.xml").decode() and "<f>" not in z.read("xl/worksheets/sheet1.xml").decode()
        assert "второй" in z.read("xl/workbook.xml").decode()


def test_long_keys_are_split_in_order_and_empty_tables_have_a_header(spark, tmp_path):
    ship(spark)
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 4 == 0, "b/c").otherwise("a").alias("k"), (999 - F.col("id")).alias("n"), F.lit("x").alias("name"))
    names = workbooks.write(spark, {"s": Sheet(df, [F.col("n")])}, f"file://{tmp_path}/b", "k", 300)
    assert names == ["a-001.xlsx", "a-002.xlsx", "a-003.xlsx", "b_c.xlsx"]
    got = rows_of(spark, f"file://{tmp_path}/b/*.xlsx")
    a = [int(c["n"]) for f, _, _, c in got if f.startswith("a")]
    assert a == [n for n in range(1000) if (999 - n) % 4] and sum(f == "a-001.xlsx" for f, *_ in got) == 300
    assert workbooks.write(spark, {"s": Sheet(df.where("false"), [F.col("n")])}, f"file://{tmp_path}/c") == ["book.xlsx"]
    with zipfile.ZipFile(tmp_path / "c" / "book.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row") == 1
    with pytest.raises(ValueError):
        workbooks.write(spark, {"s": Sheet(df, [F.col("n")])}, f"file://{tmp_path}/c")
    whole = workbooks.write(spark, {"s": Sheet(df, [F.col("n")]), "t": Sheet(df.select("k"), [])}, f"file://{tmp_path}/d", None, 1500)
    assert whole == ["book-001.xlsx", "book-002.xlsx"] and len(rows_of(spark, f"file://{tmp_path}/d/*.xlsx")) == 2000
