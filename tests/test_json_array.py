"""Arrays of JSON documents that are read in small splits, against the standard library."""

import json
import random

import pytest
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pricewright.sources.json_array import read_json_array

GOODS = StructType([StructField("full", StringType()), StructField("tags", ArrayType(StringType()))])
SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("goods", GOODS), StructField("items", ArrayType(StructType([StructField("id", LongType())])))])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


def element(rng, i):
    odd = ['x}y', '{"id": 1}', "a\\\"}b", "\\\\", "[", "]}", "é}😀", ',:"', ""]
    name = "".join(rng.choice(odd + ["plain"]) for _ in range(rng.randint(0, 4)))
    return {"id": i, "name": name, "goods": rng.choice([None, {"full": rng.choice(odd), "tags": [rng.choice(odd) for _ in range(rng.randint(0, 3))]}]), "items": [{"id": 100 + i}] * rng.randint(0, 2)}


def document(rng, kind):
    rows = [element(rng, i) for i in range(30)]
    if kind == "root":
        return [*rows[:10], 5, "s}", None, [rows[0]], *rows[10:]], rows
    if kind == "wrapped":
        return {"note": "a}{", "data": {"x}": 1}, "count": {"items": 3}, "result": rows, "after": [{"id": 7}]}, rows
    if kind == "deep":
        return {"response": {"meta": [{"id": 9}], "page": {"rows": rows, "n": 1}}}, rows
    return {"root": {"goods": {"good": rows}}, "items": [{"id": 1}]}, rows


def of(row):
    d = row.asDict(True)
    return json.dumps(d, sort_keys=True)


@pytest.mark.parametrize("size", [40, 230, 1 << 27])
@pytest.mark.parametrize("kind", ["root", "wrapped", "deep", "path"])
def test_elements_equal_the_standard_library(spark, tmp_path, small_splits, kind, size):
    rng = random.Random(len(kind))
    document_, rows = document(rng, kind)
    (tmp_path / "a").write_text(json.dumps(document_, ensure_ascii=kind == "deep", indent=1 if kind == "wrapped" else None), encoding="utf-8")
    small_splits(size)
    got = read_json_array(spark, str(tmp_path / "a"), SCHEMA, ["none.such", "root.goods.good"] if kind == "path" else None)
    assert sorted(map(of, got.collect())) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    if size == 40:
        assert got.rdd.getNumPartitions() > 20


def test_files_apart_and_files_that_are_cut_off(spark, tmp_path, small_splits):
    small_splits(50)
    (tmp_path / "1.json").write_text("﻿" + json.dumps([{"id": i, "name": "n" * 30} for i in range(5)]), encoding="utf-8")
    (tmp_path / "2.json").write_text('{"items": [{"id": 10, "name": "whole"}, {"id": 11, "name": "' + "x" * 200)
    (tmp_path / "3.json").write_text("")
    (tmp_path / "4.json").write_text('{"nothing": 1}')
    assert sorted(r.id for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()) == [0, 1, 2, 3, 4, 10]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text("[]")
    assert read_json_array(spark, str(tmp_path / "e"), SCHEMA).collect() == []
