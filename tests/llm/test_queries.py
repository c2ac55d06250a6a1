"""Each registered query on small tables against its definition, and the rows that are easily forgotten."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import queries
from pricewright.llm.cover_tree import near_vectors
from pricewright.llm.langid import UNKNOWN, fit as fit_lang, predict
from pricewright.llm.ngram_join import ngram_join
from pricewright.llm.nra import top_k
from pricewright.llm.packing import n_words, pack
from pricewright.llm.sentencepiece import decode, encode
from pricewright.llm.toxicity import fit as fit_tox, score

from test_text_ops import brute_dedup, brute_join, words

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
PARTS = {"en": "the and ing th er ou", "de": "der und sch ein ich ung"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("tables")
    say = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang].split()) for _ in range(rng.randint(2, 4))) for _ in range(n))
    passage = "\n".join(say("en", 12) for _ in range(6))
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = say(lang, rng.randint(20, 90))
        if i % 6 == 0:
            text = text.replace(" ", " vilewort ", 3)
        if i in (50, 90):
            text += "\n" + passage
        rows.append((i, text, lang if i % 7 else None, "s", len(text), "x"))
    rows[101] = (101, rows[100][1] + " more", "en", "s", 0, "x")
    rows[102] = (102, rows[100][1], "en", "s", 0, "x")
    rows += [(120, None, "en", "s", 0, None), (121, "", None, None, None, None), (122, "12 %%", "en", "s", 1, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(1).normal(size=(160, 8))
    x[60:] = x[np.arange(100) % 30] + np.random.default_rng(2).normal(scale=0.08, size=(100, 8))
    x[7] = x[6]  # ties
    vecs = [(i, [float(c) for c in v], "l") for i, v in enumerate(x.astype(np.float32))] + [(160, None, "l"), (161, [float("nan")] * 8, "l"), (200, [0.0] * 8, None)]
    spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<nav>m</nav><article><h1>T</h1><p>a&amp;b</p></article>"), (2, None, None)], "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), {r[0]: r[1] for r in rows}, {v[0]: np.array(v[1]) for v in vecs if v[1]}, {r[0]: r[2] for r in rows}


def rows_of(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in rows_of(spark, tables, "op1_html_extraction")) == [(1, "u", "T\na&b", 5), (2, None, "", 0)]


def test_op2(spark, tables):
    v = {i: x / np.linalg.norm(x) for i, x in tables[2].items() if np.isfinite(x).all() and x.any()}
    near = {i: [j for j in v if j != i and float(v[i] @ v[j]) >= 0.9] for i in v}
    low = {i: i for i in [*v, 160, 161, 200]}
    for _ in v:
        low |= {i: min([low[i], *(low[j] for j in near[i])]) for i in v}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows_of(spark, tables, "op2_embedding_dedup")}
    assert got == {i: (len(near.get(i, [])), c, i == c) for i, c in low.items()}


def test_op3(spark, tables):
    got = rows_of(spark, tables, "op3_packing")
    assert sorted(r.doc_id for r in got) == sorted(tables[1]) and all(r.n_tokens == len((tables[1][r.doc_id] or "").split()) <= r.bucket for r in got)


def test_op4(spark, tables):
    z = {i: np.floor(256 * x).astype(int) for i, x in tables[2].items() if np.isfinite(x).all()}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows_of(spark, tables, "op4_top_k"))
    want = []
    for q in (i for i in z if i % 50 == 0):
        best = sorted((-int(z[q] @ z[i]), i) for i in z if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_op5(spark, tables):
    got = {r.doc_id: r for r in rows_of(spark, tables, "op5_language_id")}
    assert set(got) == set(tables[1])
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(got[i].lang_pred == ("en" if i % 3 else "de") for i in range(120)) >= 117 and {got[i].lang_pred for i in (120, 121, 122)} == {UNKNOWN}


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, tables, "op6_token_store")}, 0
    for i in sorted(tables[1]):
        ids = np.array([*library.encode(tables[1][i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7(spark, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows_of(spark, tables, "op7_sentencepiece"):
        ids, text = library.encode(tables[1][r.doc_id] or ""), tables[1][r.doc_id] or ""
        assert (r.n_pieces, r.ids_crc32, r.n_chars_decoded, r.text_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(text), zlib.crc32(text.encode()))


def test_op8(spark, tables):
    got = {r.doc_id: r for r in rows_of(spark, tables, "op8_toxicity")}
    assert set(got) == set(tables[1])
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert {i for i, r in got.items() if r.predicted} == set(range(0, 120, 6)) - {102}  # labelled toxic, but a copy of a clean text


def test_op9(spark, tables):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(spark, tables, "op9_ngram_join")} == brute_join(tables[1])


def test_op10(spark, tables):
    got = {r.doc_id: r.text for r in rows_of(spark, tables, "op10_line_dedup")}
    assert got == brute_dedup(tables[1], 50) and got[90] != tables[1][90] and got[50] == tables[1][50]


# ---- rows that are easily forgotten


def test_repeated_and_null_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    # of a repeated id the vector that comes first by value counts; a null id links with nothing
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 50: (0, 50), None: (0, None)}
    best = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 50 == 0, k=2).orderBy("rank").collect()]
    assert best == [(50, 1, 1, 0), (50, 2, 2, 0)]


def test_packing_of_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a b c"), (2, None)], "doc_id bigint, text string").withColumn("bucket", F.lit(9)).withColumn("n", F.lit("x"))
    got = pack(table, n_words(F.col("text"))).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (1, 1), (1, 3), (2, 0)]


def test_language_and_toxicity_of_empty_tables_and_odd_rows(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert predict(none, fit_lang(none)).count() == 0 and score(none, fit_tox(none, labels)).count() == 0
    odd = spark.createDataFrame([(None, "the and there", "en", "s", 1, "x"), (1, "und der " * 60_000, "de", "s", 1, "x"), (1, "the and ther", "en", "s", 1, "x"), (2, "und ich", "de", "s", 1, "x")], DOCS)
    got = predict(odd.withColumn("score", F.lit("s")).withColumn("l", F.lit(1)), fit_lang(odd)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "de"), (1, "en"), (2, "de")]


def test_pieces_of_empty_tables_and_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert decode(encode(spark.createDataFrame([], DOCS), path), path).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, "c"), (2, "x" * 30_000)], "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("n_pieces", F.lit(1))
    back = decode(encode(odd, path), path).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in back) == [(0, 3), (1, 0), (1, 1), (2, 30_000)]


def test_very_long_texts_join(spark):
    long = words(random.Random(2), 40_000, 10**6)
    table = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id bigint, text string").withColumn("d", F.lit(1)).withColumn("n", F.lit("x"))
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(table).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_pipeline_of_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
