"""Operators on texts against brute force and plain definitions, with the awkward rows."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import components as comp
from pricewright.llm.hashing import Words
from pricewright.llm.html_extract import SURGE, WIDTH, extract, extract_pages, spans
from pricewright.llm.langid import UNKNOWN, Model as LangModel, fit as fit_lang, predict
from pricewright.llm.line_dedup import line_dedup
from pricewright.llm.ngram_join import ngram_join
from pricewright.llm.packing import boundaries, n_words, pack
from pricewright.llm.toxicity import MEAN, STEPS, Model, fit, least_margin, score, segments

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, t int, rank int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- line dedup


def brute_dedup(texts, least):
    lines = {d: [(p, " ".join(x.split())) for p, x in enumerate(t.split("\n")) if x.strip()] for d, t in texts.items() if t is not None}
    flat = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    at = {}
    for d, i in flat:
        at.setdefault(lines[d][i][1], []).append((d, i))
    dead = {d: set() for d in lines}
    for d, i in flat:
        for e, j in at[lines[d][i][1]]:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                n += 1
            if sum(len(lines[d][i + k][1].split()) for k in range(n)) >= least:
                dead[d].update(lines[d][i + k][0] for k in range(n))
    return {d: t if t is None or not dead[d] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in dead[d]) for d, t in texts.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    passages = ["\n".join(words(rng, rng.choice([3, 12, 30, 60])) for _ in range(rng.randint(1, 5))) for _ in range(6)]
    texts = {}
    for d in range(60):
        parts = [words(rng, rng.randint(1, 40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        texts[d] = "\n\n".join(parts) if d % 7 == 0 else "\n".join(parts)
    texts |= {60: None, 61: "", 62: "\n\n", 63: "same line of five words\n" * 40, 64: texts[3], 65: "  " + texts[3].replace("\n", " \n")}
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute_dedup(texts, 50)


def test_line_dedup_finds_the_run_behind_shorter_ones(spark):
    """A passage whose ends stand earlier in runs that are too short by themselves; and random runs over few lines."""
    rng = random.Random(6)
    passage = [words(rng, 12, 10**6) for _ in range(5)]
    filler = [words(rng, 40, 10**6) for _ in range(4)]
    cuts = [passage[:4], passage[1:], passage, passage]
    texts = {d: "\n".join([filler[d], *c]) for d, c in enumerate(cuts)}
    pool = [words(rng, rng.choice([1, 4, 9, 12, 26, 49, 55]), 10**6) for _ in range(12)]
    texts |= {d: "\n".join(pool[(k + j) % 12] if rng.random() < 0.9 else rng.choice(pool) for k in [rng.randrange(12)] for j in range(rng.randint(1, 14))) for d in range(4, 90)}
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute_dedup(texts, 50)
    assert got[2] == texts[2] and got[3] == filler[3]


def test_line_dedup_behind_many_slices_and_in_long_documents(spark):
    rng = random.Random(8)
    run = [words(rng, 5, 10**6) for _ in range(10)]
    texts = {d: "\n".join([words(rng, 40, 10**6), *run[d % 5 : d % 5 + 6]]) for d in range(300)}
    texts |= {1000: "\n".join(run), 1001: "\n".join(run), 1002: "", 1003: None}
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute_dedup(texts, 50) and got[1001] == "" and got[1000] == texts[1000]
    long = {0: "one two three four five\n\n" * 20_000, 1: "\n".join(words(rng, 6, 10**6) for _ in range(20_000)), 2: "head\n" + "one two three four five\n" * 30}
    at = time.perf_counter()
    rows = {r.doc_id: r for r in line_dedup(docs(spark, list(long.values()), list(long))).collect()}
    assert rows[0].text.split() == ["one", "two", "three", "four", "five"] and rows[1].text == long[1] and rows[2].text.split() == ["head"]
    assert time.perf_counter() - at < 120


def test_line_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    run = "\n".join(words(rng, 10) for _ in range(6))
    got = [tuple(r) for r in line_dedup(docs(spark, [run, run, run, run], [None, 4, 4, 9])).collect()]
    assert sorted(got, key=str) == sorted([(None, run, 6, 0), (4, run, 6, 0), (4, run, 6, 0), (9, "", 6, 6)], key=str)


def test_line_dedup_of_other_texts_under_one_id(spark):
    rng = random.Random(5)
    run, other = ("\n".join(words(rng, 10) for _ in range(10)) for _ in range(2))
    got = [tuple(r) for r in line_dedup(docs(spark, [run, run, "other text\nwith two lines"], [1, 2, 2])).collect()]
    assert sorted(got) == [(1, run, 10, 0), (2, "", 10, 10), (2, "other text\nwith two lines", 2, 0)]
    got = [tuple(r) for r in line_dedup(docs(spark, [run, other, other], [2, 2, 3])).collect()]
    assert sorted(got) == sorted([(2, run, 10, 0), (2, other, 10, 0), (3, "", 10, 10)])
    got = [tuple(r) for r in line_dedup(docs(spark, [run, run + "\nmore"], [2, 2])).collect()]  # one of the two keeps the run
    assert sorted(len(r[1].split("\n")) for r in got) in ([1, 10], [0, 11], [1, 11]) and sum(r[3] for r in got) == 10


def test_line_dedup_of_nothing(spark):
    assert line_dedup(docs(spark, ["a"]).limit(0)).count() == 0


# ---- n-gram join


def brute_join(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    common = words(rng, 60)
    texts, d = {}, 0
    for _ in range(25):
        base = words(rng, rng.choice([1, 3, 5, 6, 9, 40, 120, 300]), 200).split()
        if rng.random() < 0.4:
            base += common.split()
        for _ in range(rng.choice([1, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 2)] = [f"n{rng.randrange(9)}" for _ in range(rng.randint(0, 2))]
            texts[d] = " ".join(w).upper() if rng.random() < 0.2 else "\t ".join(w)
            d += 1
    texts |= {d: None, d + 1: "", d + 2: " \n\t", d + 3: "É é a b", d + 4: "é É a b"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute_join(texts)


def test_ngram_join_of_nothing_and_repeated_ids(spark):
    assert ngram_join(docs(spark, ["a"]).limit(0)).count() == 0
    got = ngram_join(docs(spark, ["b c", "a c", "a c", None], [1, 1, 2, None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1)]


# ---- components


def test_components_by_either_way(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(1, None), (500, 500)], "a bigint, b bigint").repartition(5)
    want = comp.labels(400, a, b)
    nodes = set(a[a != b].tolist()) | set(b[a != b].tolist())
    for local in (comp.LOCAL, 0):
        got = {r.node: r.component for r in comp.components(edges, local).collect()}
        assert set(got) == nodes and all(want[n] == c for n, c in got.items())
    assert comp.components(edges.limit(0)).count() == 0


# ---- packing


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        edges, counts = np.sort(rng.choice(100, n, replace=False)), rng.integers(1, 20, n)
        for k in range(1, 5):
            cost = lambda bs: sum(c * (min(b for b in bs if b >= e) - e) for e, c in zip(edges, counts))
            best = min(cost([*bs, edges[-1]]) for m in range(k) for bs in combinations(edges[:-1], m))
            got = boundaries(edges, counts, k)
            assert len(got) <= k and cost(got) == best


def test_packing_keeps_every_row_within_the_budget(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.choice([1, 5, 50, 400, 3000])) for _ in range(300)] + [None, "", "  "]
    rows = pack(docs(spark, texts), n_words(F.col("text")), buckets=5, budget=1000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(303))
    batches = {}
    for r in rows:
        assert r.n_tokens + r.padding == r.bucket and r.padding >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert len({b for b, _ in batches}) <= 5
    for (bucket, _), own in batches.items():
        assert len(own) == 1 or len(own) * bucket <= 1000
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert pack(docs(spark, texts).limit(0), n_words(F.col("text"))).count() == 0


# ---- toxicity


def test_segments_are_ruzzo_and_tompas():
    assert [s for _, _, s in segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0]))] == [4, 3, 7]
    assert segments(np.zeros(0)) == [] and segments(-np.ones(3)) == []


def test_toxicity_on_held_out_rows_and_odd_texts(spark):
    rng = random.Random(4)
    texts = []
    for i in range(600):
        w = words(rng, rng.randint(20, 200)).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "badthing", "Nasty!"]))
        texts.append(" ".join(w))
    table = docs(spark, texts + [None, "", "123 %%%", "x" * 50_000])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(0, 480)], "doc_id bigint, toxic int, quality int")
    got = {r.doc_id: r for r in score(table, fit(table, labels)).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(480, 600)) >= 117
    assert all(got[i].predicted == 0 and got[i].passages == [] for i in range(600, 604))
    hit = got[480].passages[0]
    assert re.search("vilewort|badthing|Nasty", texts[480][hit.start : hit.end])
    assert score(table.limit(0), Model(np.zeros(1 << 20, np.float32))).count() == 0
    assert {r.predicted for r in score(table, fit(table, labels.limit(0))).collect()} == {0}


def test_least_margin_is_the_smallest_that_keeps_clean_text_below_zero():
    rng = np.random.default_rng(5)
    for strong in (0.02, 0.2, 0.6):
        best = np.where(rng.random(4000) < strong, np.round(rng.exponential(1.0, 4000) * 16) / 16, 0)
        low = -0.1 - rng.random(4000) * 0.1
        at = np.minimum(np.ceil(best * 16).astype(int), STEPS)
        got = least_margin(*(np.bincount(at, x, STEPS + 1) for x in (np.ones(4000), best, low)))
        mean = lambda m: np.where(best > m, best - m, low).mean()
        assert got == next(j / 16 for j in range(STEPS) if mean(j / 16) <= MEAN)


def test_toxicity_of_a_small_corpus_and_repeated_ids(spark):
    rng = random.Random(7)
    texts = [words(rng, 60) + (" vilewort vilewort vilewort" if i % 5 == 0 else "") for i in range(60)]
    table = docs(spark, texts + texts[:3], [*range(60), 60, 60, None])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = [(r.doc_id, r.predicted) for r in score(table, fit(table, labels)).collect()]
    assert len(got) == 63 and got.count((60, 1)) == 1 and got.count((60, 0)) == 1
    assert {i for i, p in got if p} == set(range(0, 61, 5))


# ---- language ID


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"en": "the and ing th er ou", "de": "der und sch ein ich ung", "fr": "les et eau oi ment é", "es": "los y ción ado ñ que"}
    rows = []
    for i in range(400):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang if i < 300 else None))
    table = spark.createDataFrame(rows + [(400, None, None), (401, "", "en"), (402, "12 %% 34", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in predict(table, fit_lang(table)).collect()}
    assert sum(got[i].lang_pred == ("en", "de", "fr", "es")[i % 4] for i in range(300, 400)) >= 97
    assert all(got[i].lang_pred == UNKNOWN and got[i].score == 0 for i in (400, 401, 402)) and all(0 <= r.score <= 1 for r in got.values())
    assert predict(table, LangModel()).where(f"lang_pred <> '{UNKNOWN}'").count() == 0
    assert predict(table, fit_lang(table.where("doc_id % 4 = 0"))).where("doc_id < 300").select("lang_pred").distinct().count() == 1


# ---- HTML


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("<nav>x</nav><article><h1>T</h1><p>a&amp;b <b>c</b></p>\n<p>d &nbsp; e</p></article><footer>f</footer>", "T\na&b c\nd e"),
    ("<article><p>one<p>two<script>var t='</p>'</script><aside>no</aside><p>three<!-- <p>x</p> --><div class='ad-box'>buy</div><section id=comments><p>me too</p></section></article>", "one\ntwo\nthree"),
    ("<article><p>cut off he", "cut off he"), ("<article><p>cut <b", "cut"), ("<article><p>1 < 2 & 3</p></article>", "1 < 2 & 3"),
    ("<ul><li><a href=x>menu</a></ul><div><p>" + "long text " * 20 + "</p><p>end.</p></div>", ("long text " * 20).strip() + "\nend."),
])
def test_extract(html, text):
    assert extract(html) == text


SIXTY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(("html", "text"), [
    (f'<div class="has-sidebar layout"><p>{SIXTY}</p><div class="sidebar">side</div></div>', SIXTY), (f'<div class="search-results-article"><p>{SIXTY}</p></div>', SIXTY),
    (f'<article><p>{SIXTY}</p><p class="post-share-text">keep</p><p class="share-box">no</p></article>', SIXTY + "\nkeep"), ("<p>Only short.</p>", "Only short."),
    (f'<p>Short.</p><div id="comments"><p>{SIXTY}</p></div>', "Short."), (f"<form id=f><p>{SIXTY}</p><input><aside>no</aside></form>", SIXTY),
    (f'<div class="has-sidebar"><div class="sidebar">{SIXTY}</div><main><h1>T</h1><p>by x</p><p>2020</p><p>{SIXTY}</p><p>end</p></main></div>', f"T\nby x\n2020\n{SIXTY}\nend"),
    (f'<article><p>a teaser</p></article><div><p>{SIXTY}</p><p>{SIXTY}</p></div>', f"a teaser\n{SIXTY}\n{SIXTY}"),
])
def test_what_is_marked_as_noise_yields_to_the_text(html, text):
    assert extract(html) == text


def test_spans_are_those_of_the_plain_distribution():
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 5, 30, 90, 300]) if rng.random() < 0.8 else 0 for _ in range(rng.randint(0, 30))]
        block = [sum(w[i : i + WIDTH]) for i in range(len(w))] + [0]
        least, out, i = min(SURGE, max(block) / 2), [], 0
        while i < len(w):
            if w[i] and block[i] >= least:
                j = i
                while j < len(w) and (block[j] or block[j + 1]):
                    j += 1
                out.append((i, j))
                i = j
            i += 1
        assert spans(np.array(w, int)) == out


@pytest.mark.parametrize("page", ["<a " * 50_000, "<div>" * 50_000 + "</b>" * 50_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<svg/>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<a \"" * 50_000 + ">", "<" * 100_000, "<div class=ad>" * 50_000 + "x"])
def test_hostile_pages_take_linear_time(page):
    at = time.perf_counter()
    extract(page)
    assert time.perf_counter() - at < 10


def test_extract_of_no_pages_and_repeated_ids(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<p>a</p>", "x", 1), (1, "u", "<p>b</p>", "x", 1), (None, None, "<p>c</p>" + "<p>d</p>" * 20_000, None, None)]
    got = sorted(r.text[:9] for r in extract_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == ["a", "b", "c\nd\nd\nd\nd"]


def test_extract_pages_counts_code_points(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é😀</p></article>", 5), (2, None, None, 6)], "page_id bigint, url string, html string, text int")
    assert [tuple(r) for r in extract_pages(pages).orderBy("page_id").collect()] == [(1, "u", "é😀", 2), (2, None, "", 0)]


def test_word_hashes_follow_the_words():
    w = Words(["aB c\td".encode(), b"", "AB É".encode()])
    assert w.first.tolist() == [0, 3, 3, 5] and w.hash[0] == w.hash[3] and len(set(w.hash.tolist())) == 4
    assert zlib.crc32(b"") == 0


@pytest.mark.parametrize(("html", "text"), [
    (f'<div class="post comments-open"><p>{SIXTY}</p></div>', SIXTY), (f'<div class="comments-open"><article><p>{SIXTY}</p></article></div>', SIXTY),
    (f'<div id="app" class="cookie-banner-open"><main><p>{SIXTY}</p></main></div>', SIXTY), (f'<div class="page has-overlay"><p>{SIXTY}</p></div>', SIXTY),
    (f'<section class="no-comments"><p>{SIXTY}</p></section>', SIXTY), (f'<article><p>a</p><p class="hidden-gem">{SIXTY}</p></article>', f"a\n{SIXTY}"),
    (f'<div class="how-to-reply"><p>{SIXTY}</p></div>', SIXTY), (f'<div class="comments"><article><p>{SIXTY}</p></article></div>', SIXTY),
    *[(f"<nav>{'<span>' * n}m</nav><article><p>{SIXTY}</p></article>", SIXTY) for n in (200, 300, 5000)], *[(f"<nav>{'<div>' * n}m</nav><article><p>{SIXTY}</p></article>", SIXTY) for n in (300, 5000)],
    (f'<article><p>{SIXTY}</p></article><div class="sidebar"><p>{SIXTY} {SIXTY} {SIXTY}</p></div>', SIXTY),
    (f'<article><p>ten words are here</p><div class="ad"><p>{SIXTY} {SIXTY}</p></div></article>', "ten words are here"),
    (f'<article><p>{SIXTY}</p><div class="related"><article><p>teaser {SIXTY}</p></article></div></article>', SIXTY),
    (f'<article><p>{SIXTY}</p></article><div class="related"><article>one</article><article>two</article></div>', SIXTY),
    (f"<div>{'<div class=ad>' * 300}<div class=comments>{SIXTY}</div></div>" + "</div>" * 300 + f"<p>{SIXTY}</p>", SIXTY),
])
def test_marks_never_take_the_page_with_them(html, text):
    assert extract(html) == text


LINKS = "".join(f"<li><a href=x>see {i} there</a></li>" for i in range(5))


@pytest.mark.parametrize(("html", "text"), [
    (f"<article><p>{SIXTY}</p><ul>{LINKS}</ul><p>Of.</p></article>", f"{SIXTY}\nOf."),  # links dive inside an article
    (f"<article><p>{SIXTY}</p><p><a href=x>source</a></p></article>", f"{SIXTY}\nsource"), (f"<article><h1><a href=x>T</a></h1><p>{SIXTY}</p></article>", f"T\n{SIXTY}"),
    (f"<article><p>{SIXTY}</p></article><div><p>{SIXTY}</p></div>", f"{SIXTY}\n{SIXTY}"),  # a full text outside rises
    (f"<p>Posted today.</p><article><p>{SIXTY}</p><p>Of.</p></article><p>All rights.</p>", f"{SIXTY}\nOf."), (f"<article><ul>{LINKS}</ul></article>", "\n".join(f"see {i} there" for i in range(5))),
])
def test_the_distribution_decides_inside_articles_and_outside(html, text):
    assert extract(html) == text
