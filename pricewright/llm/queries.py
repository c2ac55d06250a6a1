"""The ``opN_<name>`` queries and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import n_words, pack

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, n_words(F.col("text")))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nra import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import shared_path
    from .token_store import read_store, write_store

    path = shared_path(spark, "store")
    write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to, by its checksum."""
    import public_tokenizers

    from .sentencepiece import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars_decoded"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, _table(spark, sf_dir, "labels").where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "passages")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"))


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in the whole mix: the heavy sources fade out, the light ones come in late."""
    from .curriculum import mix
    from .packing import n_words

    schedules = [[(0.0, 7.5), (1.0, 2.5)], [(0.0, 2.0)], [(0.0, 0.5), (0.5, 0.5), (1.0, 2.5)]]
    got = mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), n_words(F.col("text")), schedules)
    return got.select("doc_id", "size", "source_size", "target", "taken", "position", F.size("copies").alias("n_copies"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_packing": op3_packing,
    "op4_top_k": op4_top_k,
    "op5_language_id": op5_language_id,
    "op6_token_store": op6_token_store,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_curriculum_mix": op11_curriculum_mix,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

_MIX = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
 w AS (SELECT *, 3 * source_size AS room, CASE r % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
 o AS (SELECT *, coalesce(sum(room) OVER b, 0)::BIGINT AS room_before, coalesce(sum(w) OVER b, 0) AS w_before FROM w WINDOW b AS (ORDER BY room / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT sum(source_size)::BIGINT AS words, sum(w) AS weights FROM w),
 l AS (SELECT arg_min((words - room_before) / (weights - w_before), w_before) AS level FROM o, t WHERE room_before + (room / w) * (weights - w_before) >= words),
 g AS (SELECT source, source_size, r, least(room::DOUBLE, level * w) AS target FROM w, l),
 p AS (SELECT d.doc_id, size, source_size, r, target, floor(target + 0.5)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 c AS (SELECT *, greatest(0, least(size, goal - before)) AS c0, greatest(0, least(size, goal - before - source_size)) AS c1, greatest(0, least(size, goal - before - 2 * source_size)) AS c2, CASE WHEN target > 0 THEN before / target END AS u FROM p),
 y AS (SELECT *, CASE r % 3 WHEN 1 THEN u * 5.0::DOUBLE WHEN 2 THEN u * 2.0::DOUBLE ELSE u * 1.0::DOUBLE END AS y FROM c)
SELECT doc_id, size, source_size, target, (c0 + c1 + c2)::BIGINT AS taken, (CASE WHEN c0 > 0 THEN 1 ELSE 0 END + CASE WHEN c1 > 0 THEN 1 ELSE 0 END + CASE WHEN c2 > 0 THEN 1 ELSE 0 END)::INTEGER AS n_copies,
 CASE WHEN c0 > 0 THEN CASE r % 3 WHEN 1 THEN CASE WHEN y > 0 THEN 2 * y / (7.5 + sqrt(greatest(56.25 - 10.0 * y, 0.0))) ELSE 0 END WHEN 2 THEN y / 2.0
 ELSE CASE WHEN y >= 0.25 THEN 0.5 + CASE WHEN y > 0.25 THEN 2 * (y - 0.25) / (0.5 + sqrt(0.25 + 8.0 * (y - 0.25))) ELSE 0 END WHEN y > 0 THEN 2 * y / (0.5 + 0.5) ELSE 0 END END END AS position FROM y"""

_SEARCH = r"""WITH t AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 n AS (SELECT k, doc_id, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
 m AS (SELECT k, doc_id, 75 + (25 * n * docs) // terms AS m FROM n, s), f AS (SELECT k, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
 r AS (SELECT item_id, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20"""

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, {_WHOLE} AND label IS NOT NULL),
 s AS (SELECT q.vec_id AS a, e.vec_id AS o, q.l = e.l AS same, list_dot_product(q.v, e.v)::BIGINT AS s FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
 p AS (SELECT a, o, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, o) <= 5)
SELECT p.a AS anchor_id, p.o AS positive_id, (row_number() OVER (PARTITION BY p.a, p.o ORDER BY s.s DESC, s.o))::INTEGER AS rank, s.o AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY rank <= 3"""

ORACLE: dict[str, str] = {"op11_curriculum_mix": _MIX, "op12_lexical_search": _SEARCH, "op13_hard_negatives": _NEGATIVES}
