"""Tables of versions and results by scope."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pricewright.operators import incremental
from pricewright.sinks import versions
from pricewright.streaming import snapshots

SCHEMA = "k string, v int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def now(spark, path, version=None):
    return sorted(tuple(r) for r in versions.read(spark, path, SCHEMA, version).collect())


def test_a_batch_is_published_as_a_whole_or_not_at_all(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert now(spark, at) == [] and versions.versions(spark, at) == []
    assert versions.publish(rows(spark, ("a", 1), ("a", 2), ("b/ c=d", 3)), at, "k", ("x", 0), 1) == 1
    first = [("a", 1), ("a", 2), ("b/ c=d", 3)]
    assert now(spark, at) == first
    negative = lambda df: df.where("v < 0")
    # b is fine, a has shrunk; a row is bad; a row has no source; too few
    for bad, kw in (([("b/ c=d", 4), ("a", 9)], {"ratio": 0.9}), ([("a", 1), ("a", -1)], {"checks": [negative]}), ([("a", 1), (None, 1)], {}), ([("a", 1)], {"least": 2})):
        with pytest.raises(versions.Rejected):
            versions.publish(rows(spark, *bad), at, "k", ("x", 1), **{"least": 1, **kw})
        assert now(spark, at) == first and len(list((tmp_path / "t" / "data").iterdir())) == 1
    assert versions.publish(rows(spark, ("a", 5), ("c", 6)), at, "k", ("x", 1), 1) == 2
    second = [("a", 5), ("b/ c=d", 3), ("c", 6)]
    assert now(spark, at) == second and now(spark, at, 1) == first
    # a replay changes nothing, another name's batch counts on its own
    assert versions.publish(rows(spark, ("a", 7)), at, "k", ("x", 1), 1) == 2 and now(spark, at) == second
    assert versions.publish(rows(spark, ("a", 7)), at, "k", ("y", 0), 1, drop=["c"]) == 3 and now(spark, at) == [("a", 7), ("b/ c=d", 3)]


def test_who_comes_second_with_a_version_is_rejected(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    versions.publish(rows(spark, ("a", 1)), at, "k", ("x", 0), 1)
    old = versions.manifest(spark, at)
    versions.publish(rows(spark, ("a", 2)), at, "k", ("x", 1), 1)
    monkeypatch.setattr(versions, "manifest", lambda *_: old)
    with pytest.raises(versions.Rejected, match="another"):
        versions.publish(rows(spark, ("a", 3)), at, "k", ("y", 0), 1)
    monkeypatch.undo()
    assert now(spark, at) == [("a", 2)]


def test_streams_deliver_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = StructType([StructField("k", StringType()), StructField("v", IntegerType())])
    go = lambda: snapshots.deliver_versions(spark, str(tmp_path / "in"), schema, f"{tmp_path}/out", str(tmp_path / "cp"), lambda d: d.withColumn("v", F.col("v") * 10), "k", least=1, ratio=0.5).awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"k": "x", "v": 1}\n{"k": "x", "v": 2}\n{"k": "x", "v": 3}\n{"k": "y", "v": 2}\n')
    go()
    (tmp_path / "in" / "2.json").write_text('{"k": "x", "v": 9}\n{"k": "y", "v": 9}\n')
    with pytest.raises(Exception, match="below 50%"):
        go()
    assert now(spark, f"{tmp_path}/out") == [("x", 10), ("x", 20), ("x", 30), ("y", 20)]


def test_only_changed_scopes_are_computed(spark, tmp_path):
    at, seen = f"{tmp_path}/p", []
    data = {"rows": [("a", 1), ("a", 3), ("b", 5), ("c", 7)]}
    inputs = lambda: rows(spark, *data["rows"])

    def compute(part):
        seen.append(sorted(r.k for r in part.select("k").distinct().collect()))
        return part.groupBy("k").agg(F.max("v").alias("v"))

    go = lambda run, settings="": incremental.refresh(inputs, "k", ["v"], compute, at, run, settings)
    assert go(0) == {"computed": 3, "kept": 0, "dropped": 0}
    assert go(1) == {"computed": 0, "kept": 3, "dropped": 0} and seen == [["a", "b", "c"]]
    data["rows"] = [("a", 3), ("a", 1), ("b", 6), ("d", 1)]  # a in another order, b changed, c gone, d new
    assert go(2) == {"computed": 2, "kept": 1, "dropped": 1} and seen[1:] == [["b", "d"]]
    assert now(spark, at) == [("a", 3), ("b", 6), ("d", 1)]
    assert go(3, "other percentiles") == {"computed": 3, "kept": 0, "dropped": 0}
    states = incremental.changed(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "scope string, fingerprint string"), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "scope string, fingerprint string"))
    assert {r.scope: r.state for r in states.collect()} == {"a": "new", "b": "unchanged", "c": "changed", "d": "gone"}

    def meanwhile(part):
        data["rows"] = [("a", 100)]
        return compute(part)

    data["rows"] = [("a", 50)]
    with pytest.raises(incremental.Changed):
        incremental.refresh(inputs, "k", ["v"], meanwhile, at, 4, "other percentiles")
    assert now(spark, at) == [("a", 3), ("b", 6), ("d", 1)]
