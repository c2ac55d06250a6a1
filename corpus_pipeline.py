"""Corpus preparation: toxicity, language ID, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
Where ids repeat, each row is judged by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import stage
from pricewright.llm.langid import UNKNOWN, fit as fit_language, predict
from pricewright.llm.line_dedup import line_dedup
from pricewright.llm.ngram_join import ngram_join
from pricewright.llm.packing import n_words, pack
from pricewright.llm.toxicity import fit as fit_toxicity, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a predicted language outweighs the label.
SURE = 0.5


def row_key() -> Column:
    """Id and hash of the text: rows that share both are exact repeats."""
    return F.struct("doc_id", F.xxhash64("text").alias("hash"))


def ids_repeat(docs: DataFrame) -> bool:
    return docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def without(docs: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """``docs`` but for the rows whose id, text and further ``columns`` are those of a row of ``rejected`` (key, columns)."""
    rows = rejected.select(F.col("key.doc_id").alias("r_id"), F.col("key.hash").alias("r_hash"), *[F.col(c).alias(f"r_{c}") for c in columns])
    same = (F.col("doc_id") == F.col("r_id")) & (F.xxhash64("text") == F.col("r_hash"))
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return docs.join(rows, same, "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model, learnt from ``labels``, calls toxic. Null ids have no decision and stay."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, score(docs.withColumn("key", row_key()), model, "key").where("predicted = 1"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (null texts and texts without a letter) and those whose label is wrong.

    A label is wrong if the model predicts another language with a score of
    ``SURE`` at least. Where no row is labelled the model knows no language:
    then only texts without a letter go. Null ids have no decision and stay.
    """
    model = fit_language(docs)
    if not model.langs:
        return docs.where(F.col("doc_id").isNull() | F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    found = predict(docs.withColumn("labelled", F.struct(row_key().alias("key"), "lang")), model, "labelled").select("labelled.*", "lang_pred", "score")
    wrong = (F.col("lang_pred") != F.col("lang")) & (F.col("score") >= SURE)
    return without(docs, found.where((F.col("lang_pred") == UNKNOWN) | wrong), "lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later occurrences of passages of 50 words or more; every document stays, ``n_chars`` follows its text.

    Rows without an id stay as they are. Rows of one id with different texts
    are documents of their own, in order of the texts' hashes.
    """
    known, unknown = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    known = known.withColumn("key", row_key() if ids_repeat(docs) else F.col("doc_id"))
    kept = line_dedup(known, "key").select("key", F.col("text").alias("kept")).dropDuplicates(["key"])
    rest = known.drop("text", "n_chars").join(kept, "key")
    count = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source", count.alias("n_chars")).unionByName(unknown.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates keep the document of the smallest id; rows without an id have no class and stay.

    Where ids repeat, each row is a document; of exact repeats (id and text)
    one row stays, also if the text has no words.
    """
    if ids_repeat(docs):
        known = stage(docs.where("doc_id IS NOT NULL").withColumn("key", F.monotonically_increasing_id()), "rows")
        found = ngram_join(known, "key").join(known.select("key", "doc_id", F.xxhash64("text").alias("hash")), "key")
        wordless = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "hash"))
        group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"), wordless.alias("wordless")]
        first = found.groupBy(*group).agg(F.min(F.struct("doc_id", "key")).alias("o")).select(F.col("o.key").alias("key"))
        return known.join(first, "key", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))
    later = ngram_join(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length-bucketed batches of the documents that are left."""
    return pack(docs, n_words(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Models and similarity classes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
