"""Mixing, lexical search and hard negatives against plain versions, and the rows that are easily forgotten."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import lexical, negatives, queries
from pricewright.llm.curriculum import mix, targets, training_order, weight
from pricewright.llm.ordering import running
from pricewright.llm.packing import n_words

DOCS = "doc_id bigint, text string, source string, size string, position int"


def test_running_totals_equal_a_walk(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), rng.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, n int, i int").repartition(5)
    got = {r.i: r.before for r in running(df, ["k"], [F.col("o"), F.col("i")], before=F.col("n")).collect()}
    want, so_far = {}, Counter()
    for k, o, n, i in sorted(rows, key=lambda r: (r[1], r[3])):
        want[i] = so_far[k]
        so_far[k] += n
    assert got == want


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_mix(rows, weights, schedules, repeats=3):
    """{row: (source_size, target, taken)} by pouring weights until no source is above its room."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words_of(text))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > repeats * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = float(repeats * size[s])
            left -= target[s]
        free -= full
    key = lambda i: (-1, -1) if i is None else (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16), i)
    stream = defaultdict(list)
    for i, text, source in rows:
        stream[source].append((key(i), len(words_of(text)), i))
    out = []
    for s, docs in stream.items():
        goal, at = math.floor(target[s] + 0.5), 0
        for _, n, i in sorted(docs, key=lambda d: (d[0], d[1])):
            taken = sum(max(0, min(n, goal - at - j * size[s])) for j in range(repeats))
            out.append((i, n, size[s], round(target[s], 6), taken))
            at += n
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(140):
        source = rng.choice(["hot"] * 5 + ["b", "c", "Z", "é", "\U0001f600", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), source))
    return rows + [(None, "x y", "hot"), (None, "x y", "hot"), (7, "again here", "b"), (7, "again here", "b"), (200, None, "c"), (201, "", "only"), (202, "\x0b a b \x0c c", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_the_plain_version(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_curriculum_mix(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == plain_mix(rows, [5, 2, 1], None)
    placed = [r.position for r in got]
    assert all((r.position is None) == (r.taken == 0) for r in got) and [p for p in placed if p is not None] == sorted(p for p in placed if p is not None) and (None not in placed or placed.index(None) == len([p for p in placed if p is not None]))


def test_positions_follow_the_schedule(spark):
    """By each moment a source has placed the share of its words that its weight has used up."""
    falls, rises = [(0.0, 2.0), (0.5, 0.0), (1.0, 0.0)], [(0.25, 0.0), (1.0, 4.0)]
    rows = [(i, "a b", s) for i in range(4000) for s in ("falls", "rises", "out")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix(docs, n_words("text"), {"falls": falls, "rises": rises})
    assert weight(falls) == 0.5 and weight(rises) == 1.5
    got = training_order(mixed).toPandas()
    assert set(got["source"]) == {"falls", "rises"} and list(got["offset"]) == list(range(0, 2 * len(got), 2)) and got["position"].is_monotonic_increasing
    for t in (0.1, 0.25, 0.4, 0.7):
        done = {s: ((got["source"] == s) & (got["position"] < t)).sum() / (got["source"] == s).sum() for s in ("falls", "rises")}
        assert abs(done["falls"] - (1 - (1 - min(t, 0.5) / 0.5) ** 2)) < 1e-3 and abs(done["rises"] - (max(0, t - 0.25) / 0.75) ** 2) < 1e-3
    sums = {r.source: (r.target, r.taken) for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert sums == {"falls": (6000.0, 6000), "rises": (18000.0, 18000), "out": (0.0, 0)}


def test_mix_of_nothing_and_of_empty_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix(empty, n_words("text"), [[(0, 1)]]).collect() == []
    got = mix(spark.createDataFrame([(1, None, None), (2, "", "s")], empty.schema), n_words("text"), [[(0, 1)]]).collect()
    assert sorted((r.doc_id, r.target, r.taken, r.position, len(r.copies)) for r in got) == [(1, 0.0, 0, None, 0), (2, 0.0, 0, None, 0)]
    for bad in ([], [(0, -1)], [(0, 1), (2, 1)], [(0.5, 1), (0.5, 2)]):
        with pytest.raises(ValueError):
            weight(bad)
    one = targets(spark.createDataFrame([("a", 10), ("b", 90)], "source string, source_size bigint"), [[(0, 9)], [(0, 1)]], 3).collect()
    assert {r.source: r.target for r in one} == {"a": 30.0, "b": 70.0}


def plain_search(docs, items, k=20):
    low = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(d, low(t)) for d, t in docs]
    docs = [(d, Counter(w), len(w)) for d, w in docs if w]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in low(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("item_bytes", [1, 1 << 24])
def test_search_equals_the_plain_version(spark, tmp_path, monkeypatch, item_bytes):
    rng = random.Random(5)
    vocabulary = ["ab", "Ab", "éa", "ÉA", "x1", "q", "\U0001f600z", "the"] + [f"w{i}" for i in range(60)]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "_", "\n", "\x00", "{", "` "]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 60)) + " the") for i in range(150)]
    docs += [(i + 150, docs[i][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[4][1]), (500, None), (501, "-- ")] + [(502, say(30_000))]
    items = [(i, say(12) + "The the") for i in range(9)] + [(20, None), (21, ""), (22, "nowhere"), (None, "ab")]
    spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id bigint, text string, item_id string, score int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 0) for i, t in items] + [(2, "~" + items[2][1], 1)], "item_id bigint, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    got = queries.op12_lexical_search(spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(docs, items[:12])


def test_search_in_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None)], docs.schema), items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).collect() == []


def test_accumulated_sums_are_those_of_a_table(monkeypatch):
    rng = np.random.default_rng(3)
    for n, top in ((5000, 70_000), (1, 1), (400, 3)):
        item, doc, impact = rng.integers(0, 300, n), rng.integers(0, top, n), rng.integers(1, 1 << 40, n)
        want = Counter()
        for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist()):
            want[i, d] += x
        i, d, s = lexical.accumulate(item, doc, impact)
        assert dict(zip(zip(i.tolist(), d.tolist()), s.tolist())) == want and list(zip(i, d)) == sorted(zip(i, d))
    monkeypatch.setattr(lexical, "TEXT_BYTES", 3)
    text = "Abc déf12 _x-" * 40
    assert [t for run in lexical.terms(text.encode()) for t in run] == re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def plain_negatives(rows):
    out = []
    z = {d: np.floor(256 * np.array(v, np.float64)).astype(int) for d, _, v in rows}
    label = {d: l for d, l, _ in rows}
    for a in sorted(z):
        if a % 50:
            continue
        others = sorted((-int(z[a] @ z[d]), d) for d in z if d != a and len(z[d]) == len(z[a]))
        for s, p in [x for x in others if label[x[1]] == label[a]][:5]:
            good = [(t, d) for t, d in others if label[d] != label[a] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, i + 1, d, -s, -t) for i, (t, d) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("seed,size", [(0, 1 << 22), (1, 2000), (2, 2000)])
def test_negatives_equal_the_plain_version(spark, tmp_path, monkeypatch, seed, size):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8)) * (3 if seed else 1)
    rows = []
    for i in range(700):
        v = centers[rng.integers(12)] + rng.normal(scale=0.3, size=8)
        if i > 500:
            v = centers[0]  # many copies of one vector, so many ties
        rows.append((i, int(rng.integers(0, 10 if seed else 3)), [float(x) for x in v.astype(np.float32)]))
    rows += [(1000, 1, [1.0, 2.0]), (1050, 1, [2.0, 2.0]), (1051, 2, [1.5, 1.5]), (1100, 4, [9.0])]
    odd = [(2000, None, rows[0][2]), (2050, 1, None), (2051, 1, [float("nan")] * 8), (2100, 1, [None] + [0.0] * 7), (None, 1, rows[0][2]), (2150, 1, [])]
    spark.createDataFrame([(*r, "x", 0) for r in [*rows, *odd, rows[3]]], "vec_id bigint, label int, embedding array<float>, rank string, score int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(negatives, "TASK_BYTES", size)
    monkeypatch.setattr(negatives, "LIST", 40)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "SAMPLE", 200)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    changed = [(d, (l + 1) % 10 if d % 7 == 0 else l, v) for d, l, v in rows]
    assert got == plain_negatives(changed) and len(got) > 50


def test_negatives_of_nothing_and_of_texts_as_labels(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label string, embedding array<double>")
    assert negatives.mine(empty, F.col("label"), F.col("vec_id") == 0).collect() == []
    one = spark.createDataFrame([(0, "a", [1.0, 1.0]), (1, "a", [1.0, 0.9]), (2, "b", [0.9, 0.8])], empty.schema)
    assert [tuple(r) for r in negatives.mine(one, F.col("label"), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 124416, 111104)]
    assert negatives.mine(one, F.col("label"), F.lit(False)).collect() == []


def test_visits_end_at_the_bound(monkeypatch):
    """Of well parted clusters a query's own is looked at, the others aren't."""
    rng = np.random.default_rng(4)
    centers = np.eye(8) * 4000
    lists = []
    for i, c in enumerate(centers):
        x = np.floor(c + rng.normal(scale=20, size=(30, 8))).astype(np.int64)
        lists.append((c, float(np.sqrt(((x - c) ** 2).sum(1).max())), np.arange(30) + 30 * i, np.zeros(30, np.int64), x))
    looked = []
    plain = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: looked.append(len(a)) or plain(a, b))
    q = np.stack([x[4][0] for x in lists])
    low, high = np.full((8, 1), np.iinfo(np.int64).min), np.full((8, 1), np.iinfo(np.int64).max)
    got = list(negatives.visit(q, np.arange(8) * 30, np.zeros(8, np.int64), low, high, low, lists, 3, True))
    assert len(got) == 24 and sum(looked) == 8 and all(d // 30 == i for i, _, d, _ in got)
