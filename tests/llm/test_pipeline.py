"""The stages one after the other on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SYLLABLES = {"en": "the and ing th er ou", "de": "der und sch ein ich ung"}


def corpus():
    rng = random.Random(9)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(2, 5)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage = text("en", 70)
    rows = []
    for i in range(300):
        lang = "en" if i % 3 else "de"
        body = text(lang, rng.randint(30, 120)).split()
        if i % 5 == 0 and i < 250:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), "vilewort")
        rows.append([i, " ".join(body), lang, f"s{i % 2}", 0])
    rows[251][1] += "\n" + passage
    rows[252][1] += "\n" + passage
    rows[254][1] = rows[253][1] + " more"  # a near copy
    rows += [[300, None, "en", "s", 0], [301, "12 %% 3", "en", "s", 0], [None, text("en", 20), "en", None, None], [303, "", "en", "s", 0]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i in range(0, 250, 5)}
    gone = {r[0] for r in rows} - set(seen["toxicity"])
    assert len(gone ^ toxic) <= 3
    assert set(seen["toxicity"]) - set(seen["language"]) == {300, 301, 303}
    assert seen["lines"].keys() == seen["language"].keys()
    assert passage in seen["lines"][251].text and passage not in seen["lines"][252].text
    assert seen["lines"][None].text and seen["lines"][251].n_chars == len(seen["lines"][251].text)
    lost = set(seen["lines"]) - set(seen["near_duplicates"])
    assert lost == {254}
    assert set(seen["packing"]) == set(seen["near_duplicates"])
    assert docs.where(F.col("padding") < 0).count() == 0


def test_run_equals_the_stages(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame(rows[:60], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(got & set(range(0, 60, 5))) <= 1 and len(got) >= 46


def test_language_decides_by_the_prediction(spark):
    rows, _ = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    unlabelled = spark.createDataFrame([[i, t, None, s, n] for i, t, _, s, n in rows], schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, unlabelled, "").collect()}
    assert {r[0] for r in rows} - kept == {300, 301, 303}
    for i in (40, 41):  # de and en, called the other; 42 has no label
        rows[i][2] = {"de": "en", "en": "de"}[rows[i][2]]
    rows[42][2] = None
    kept = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), "").collect()}
    assert {r[0] for r in rows} - kept == {40, 41, 300, 301, 303}


def test_rows_of_one_id_keep_their_own_texts(spark, tmp_path):
    rows, passage = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    other, blank = rows[258][1], [400, " ", "en", "s", 1]
    extra = [[256, other + " vilewort vilewort vilewort", "de", "s", 0], [257, "12 %% 3", "en", "s", 0], [259, rows[262][1] + " more", "en", "s", 0], [265, rows[265][1] + " more\n" + passage, "en", "s", 0], [261, rows[261][1], "de", "s", 0], [263, rows[264][1], "de", "s", 0], [None, other, "de", "s", 0]]
    rows = rows[:258] + rows[259:300] + extra
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    texts = lambda d: sorted((r.doc_id, r.text) for r in d.collect() if r.doc_id is not None and r.doc_id > 255)
    given = texts(docs)
    assert texts(corpus_pipeline.toxicity(spark, docs, str(tmp_path))) == [x for x in given if "vilewort" not in x[1]]
    assert texts(corpus_pipeline.language(spark, docs, "")) == [x for x in given if "%%" not in x[1]]
    lines = texts(corpus_pipeline.lines(spark, docs, ""))
    assert lines == sorted((i, "" if i == 264 and len(t.split()) >= 50 else t.replace("\n" + passage, "")) for i, t in given)
    # 261 stands twice; 263 has the text of 264 too, 259 one near that of 262
    kept = corpus_pipeline.near_duplicates(spark, docs.union(spark.createDataFrame([blank, blank], schema)), "")
    got = texts(kept)
    assert [i for i, _ in got].count(261) == [i for i, _ in got].count(400) == 1
    assert [i for i, _ in got].count(259) == [i for i, _ in got].count(263) == 2 and [i for i, _ in got].count(265) == 2
    assert not {262, 264} & {i for i, _ in got} and kept.where("doc_id IS NULL").count() == 1
