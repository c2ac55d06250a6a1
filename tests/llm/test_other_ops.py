"""Vectors and tokens against brute force and the tokenizers' libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewright.llm import nra
from pricewright.llm.cover_tree import Tree, dual, near_vectors, unit
from pricewright.llm.nra import top_k
from pricewright.llm.sentencepiece import Encoder, decode, encode
from pricewright.llm.token_store import cuts, merkle, read_store, verify_shards, write_store

public_tokenizers = pytest.importorskip("public_tokenizers")
NAN, INF = float("nan"), float("inf")


def sample(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 3, n):
        if rng.random() < 0.6:
            x[i] = x[rng.integers(0, n // 3)] + rng.normal(scale=rng.choice([0.0, 0.05, 0.3]), size=dim)
    return x.astype(np.float32)


ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [NAN] * 8, [INF] + [1.0] * 7, [1.0, 2.0]]


def table(spark, x):
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)] + [(len(x) + k, v, 1, 2) for k, v in enumerate(ODD)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, d int, rank int")


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_near_vectors_equal_brute_force(spark, block, monkeypatch):
    from pricewright.llm import cover_tree

    monkeypatch.setattr(cover_tree, "BLOCK_BYTES", block)
    x = sample()
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    while True:
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    got = {r.vec_id: r for r in near_vectors(table(spark, x)).collect()}
    assert len(got) == len(x) + len(ODD)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()
    assert all((got[len(x) + k].n_links, got[len(x) + k].kept) == (0, True) for k in range(len(ODD)))


def test_dual_traversal_finds_all_pairs():
    for seed in range(4):
        a, b = (unit(sample(200, 5, s).astype(np.float64)) for s in (seed, seed + 9))
        a = np.concatenate([a, b[:50]])
        got = {(i, j) for x, y in dual(Tree(a), Tree(b), 0.9) for i, j in zip(x.tolist(), y.tolist())}
        assert got == set(zip(*(k.tolist() for k in np.nonzero(np.einsum("id,jd->ij", a, b) >= 0.9))))


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(nra, "BLOCK_BYTES", block)
    x = sample(400, seed=3)
    z = np.floor(256 * x.astype(np.float64)).astype(int)
    got = {}
    for r in top_k(table(spark, x), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 50):
        s = z @ z[q]
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert sorted(got.pop(q)) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert not got


def test_vectors_of_nothing(spark):
    none = table(spark, sample(3)).limit(0)
    assert near_vectors(none).count() == 0 and top_k(none, F.col("vec_id") % 50 == 0).count() == 0


# ---- tokens


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcTHE  \n\té日😀'1.") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    return [*some, None, "", " ", "word " * 3000, "a" * 4000, "<|endoftext|> x<|endoftext|>", some[0], some[0] + " tail", ("lorem ipsum dolor " * 900) + "one", ("lorem ipsum dolor " * 900) + "two"]


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = list(zip([7 * i % 1000 for i in range(len(texts()))], texts()))
    write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/s", path)
    got = {r.doc_id: r for r in read_store(spark, f"file://{tmp_path}/s", with_ids=True).collect()}
    before = 0
    for d, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, bytes(got[d].ids)) == (before, len(ids), zlib.crc32(raw), raw)
        before += len(ids)
    assert verify_shards(spark, f"file://{tmp_path}/s").count() == 0
    stored = spark.read.parquet(f"file://{tmp_path}/s/documents").select(F.size("digests").alias("n"), F.size("own_index").alias("own")).agg(F.sum("n"), F.sum("own")).first()
    assert stored[1] < stored[0]  # shared chunks are kept once


def test_store_of_odd_rows_and_broken_stores(spark, tmp_path, monkeypatch):
    from pricewright.llm import token_store

    monkeypatch.setattr(token_store, "BLOCK", 4)
    path, at = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/s"
    schema = "doc_id bigint, text string, n int, shard int, root string"
    write_store(spark.createDataFrame([], schema), at, path)
    assert read_store(spark, at).count() == 0
    rows = [(None, "null id", 1, 2, "x"), (5, "same same", 1, 2, "x"), (5, "same same", 1, 2, "x"), (3, None, None, None, None), *[(i, f"text {i}", 1, 2, "x") for i in range(10, 40)]]
    write_store(spark.createDataFrame(rows, schema), at, path)
    got = sorted(((r.doc_id or 0), r.start, r.n_tokens) for r in read_store(spark, at).collect())
    assert [g[0] for g in got] == [0, 3, 5, 5, *range(10, 40)] and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    whole = spark.read.parquet(f"{at}/documents")
    whole.where("d IS NULL OR d <> 20").write.parquet(f"{at}2/documents")
    spark.read.parquet(f"{at}/manifest").write.parquet(f"{at}2/manifest")
    with pytest.raises(ValueError, match="manifest"):
        read_store(spark, f"{at}2")


def test_ids_of_all_kinds_of_characters_equal_the_library():
    import unicodedata

    from tokenizers import Tokenizer

    from pricewright.llm.token_words import tokenizers_memo

    path = public_tokenizers.path("word_bpe_49k.json")
    library, memo, rng = Tokenizer.from_file(path), tokenizers_memo(path), random.Random(3)
    kinds: dict[str, list[str]] = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        kinds.setdefault(unicodedata.category(c), []).append(c)
    some = ["½É", "Y²", "語½", "a½b", "Σς", "İx"]
    some += [x for c in map(chr, [*range(1, 0x600), *range(0x600, 0xD800, 97)]) for x in (f"a{c}b", f"{c}.", f"X{c}")]
    some += ["".join(rng.choice(kinds[rng.choice(list(kinds))]) if rng.random() < 0.5 else rng.choice("abcXYZ éß½²Σς.,!'<|> \n0123") for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for text, raw in zip(some, memo.texts(some)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_in_memory_are_bounded_by_number_and_bytes():
    from sys import getsizeof

    from pricewright.llm import token_words
    from pricewright.llm.token_words import Memo, split_words

    memo = Memo(lambda w: w[:8].encode(), split_words)
    held = lambda: [*memo.items(), *memo.old.items()]
    one = " ".join(map(str, range(1_000_000)))  # one text of many words, cut at white space
    assert list(memo.texts([one])) == ["".join(map(str, range(1_000_000))).encode()]
    assert len(held()) <= 2 * 400_000
    long = [" ".join(f"{i:07d}{j:07d}".ljust(n, "x") for j in range(200)) for i, n in enumerate([900] * 900 + [100_000] * 8)]
    assert all(len(raw) == 1600 for raw in memo.texts(long))
    assert sum(getsizeof(w) + getsizeof(raw) for w, raw in held()) <= 2 * 64_000_000
    memo.forget()
    assert not held() and list(memo.texts(["a b", None, "a"])) == [b"ab", b"", b"a"] and len(held()) == 2
    path = public_tokenizers.path("word_bpe_49k.json")
    used = token_words.tokenizers_memo(path)
    before = list(used.texts(["Some words, again and again"]))
    token_words.forget_words()
    assert not used and not used.old and list(used.texts(["Some words, again and again"])) == before


def test_long_texts_are_encoded_by_pieces_with_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer

    from pricewright.llm import token_words

    monkeypatch.setattr(token_words, "PIECE", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    memo, library = token_words.tokenizers_memo(path), Tokenizer.from_file(path)
    some = ["a  b\n\nlonger words, ΣΟΦΟΣ and É́ x ́y " * 3, " " * 30, "onewordwithoutanywhitespace" * 5, "tab\tand\rline\nends " * 9 + "x", "İstanbul Straße ünï " * 4, *filter(None, texts())]
    for text, raw in zip(some, memo.texts(some)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)[:200]


def test_distinct_words_of_texts_are_encoded_once_and_together():
    from pricewright.llm.token_words import Memo, split_words

    calls = []

    def many(words):
        calls.append(sorted(words.to_pylist()))
        return pa.array([w.encode() for w in words.to_pylist()], pa.large_binary())

    memo = Memo(str.encode, split_words, many=many)
    assert list(memo.texts(["b a b", None, "a\tc  a", "b"])) == [b"bab", b"", b"aca", b"b"]
    assert list(memo.texts(["d a", "c d"])) == [b"da", b"cd"]
    assert [[w for w in c if w] for c in calls] == [["a", "b", "c"], ["d"]]


def test_words_and_signs_that_the_memory_knows_do_not_go_to_the_model_again():
    from pricewright.llm.token_words import tokenizers_memo

    memo = tokenizers_memo(public_tokenizers.path("word_bpe_49k.json"))
    memo.forget()
    many, new = memo.many, []
    try:
        memo.many = lambda words: (new.append(sorted(w for w in words.to_pylist() if w)), many(words))[1]
        first = b"".join(memo.texts(["größe zxqwv, zxqwv. größe"] * 3))
        assert first == b"".join(memo.texts(["größe zxqwv, zxqwv.", "größe"] * 3))
        list(memo.texts(["zxqwv größe., zxqwv"]))
    finally:
        memo.many = many
    assert new == [sorted(["größe", "zxqwv", ",", "."]), [], [".,"]]


@pytest.mark.parametrize("memory, step, together", [(400_000, 4_000_000, 3), (3, 40, 2000), (50, 1, 1)])
def test_ids_do_not_depend_on_memory_or_steps(monkeypatch, memory, step, together):
    from tokenizers import Tokenizer

    from pricewright.llm import token_words

    for k, v in (("MEMORY", memory), ("STEP", step), ("TOGETHER", together), ("PIECE", 500)):
        monkeypatch.setattr(token_words, k, v)
    path = public_tokenizers.path("word_bpe_49k.json")
    memo, library = token_words.tokenizers_memo(path), Tokenizer.from_file(path)
    memo.forget()
    some = [*texts(), "</w> a</w> w> </", "été, ÉTÉ. e\u0301te\u0301 straße... œuvre ľahký привет, мир!", "don't x'll 's a'", "\x0b\x0c a\x0bb \u00a0 c\u2003d", ".,;!", "١٢ ²x ǅ ªb"]
    for _ in range(2):
        for text, raw in zip(some, memo.texts(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, ascii(text)[:200]
        assert len(memo) <= memory and len(memo.old) <= memory
    memo.forget()


@pytest.mark.parametrize("ending", ["</w>", None])
def test_other_tokenizers_and_models_that_miss_letters(tmp_path, ending):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    from pricewright.llm.token_words import tokenizers_memo

    end = ending or ""
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", f"a{end}", f"b{end}", "ab", f"ab{end}"]))}
    t = Tokenizer(models.BPE(vocab, [("a", "b"), ("a", "b</w>")], end_of_word_suffix=end) if ending else models.BPE(vocab, [("a", "b")]))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    t.save(f"{tmp_path}/t.json")
    some = ["ab ba abab", "a c b", "", None, "AB, ab. abc cab", "ccc c"]
    for text, raw in zip(some, tokenizers_memo(f"{tmp_path}/t.json").texts(some), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_runs_of_batches_are_bounded_and_lose_no_row(monkeypatch):
    from pricewright.llm import token_store

    monkeypatch.setattr(token_store, "TOGETHER", 5)
    monkeypatch.setattr(token_store, "STEP", 1000)
    sizes = [2, 0, 2, 3, 1, 9, 1, 1, 0]
    batches, at = [], 0
    for i, n in enumerate(sizes):
        batches.append(pa.record_batch([pa.array(range(at, at + n), pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(["x" * (2000 if i == 6 else 10)] * n, pa.string())], ["d", "r", "t"]))
        at += n
    runs = list(token_store._runs(iter(batches)))
    assert [[b.num_rows for b in run] for run in runs] == [[2, 2], [3, 1], [9], [1], [1]]
    assert [d for run in runs for b in run for d in b.column(0).to_pylist()] == list(range(at))


def test_cuts_depend_on_content_alone():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 40_000, 20_000).astype(np.uint32)
    b = np.concatenate([a[:5000], rng.integers(0, 40_000, 37).astype(np.uint32), a[5000:]])
    chunks = lambda x: {x[i:j].tobytes() for i, j in zip([0, *cuts(x)], cuts(x))}
    assert cuts(a)[-1] == len(a) and len(chunks(a) - chunks(b)) <= 3
    assert cuts(a[:0]) == [] and cuts(a[:5]) == [5] and max(np.diff([0, *cuts(np.zeros(9000, np.uint32))])) <= 1024 + 64
    assert merkle([b"a"]) == b"a" and merkle([b"a", b"b", b"c"]) != merkle([b"a", b"c", b"b"])


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(texts()))
    made = encode(spark.createDataFrame(rows, "doc_id bigint, text string"), path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in made.collect()}
    assert got == {i: lib.encode(t or "") for i, t in rows}
    assert {r.doc_id: r.text for r in decode(made, path).collect()} == {i: t or "" for i, t in rows}


def test_viterbi_is_the_best_path():
    e = Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    scores = {w: s for w, (s, _) in e.rank.items()}
    for word in ("▁hello", "▁thents", "▁aaaa", "▁éx日"):
        best = [(0.0, [])]
        for j in range(1, len(word) + 1):
            best.append(max((best[i][0] + scores.get(word[i:j], e.lowest if j - i == 1 else -np.inf), best[i][1] + [j]) for i in range(j)))
        marks = e.viterbi(np.array([[ord(c) for c in word]], np.uint64))[0]
        ends = (np.flatnonzero(marks) + 1).tolist()
        total = sum(scores.get(word[i:j], e.lowest) for i, j in zip([0, *ends], ends))
        assert ends[-1] == len(word) and abs(total - best[-1][0]) < 1e-6
