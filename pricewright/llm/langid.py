"""Language ID: the family first, then one-versus-one linear SVMs among its languages."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import short_batches, small, stage, steps
from .hashing import _BYTE, Words, mix

#: Features: byte n-grams of words with their bounds, and whole words, hashed into so many columns.
DIMS = 4096
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"

#: Families of ISO 639-1 codes; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malayic": "id ms",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    #: (name, name) or (name, "") against all others -> weights with the bias last
    planes: list[tuple[str, str]] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((DIMS + 1, 0), np.float32))


def vectors(raws: list[bytes]) -> np.ndarray:
    """Rows of square roots of feature counts, of length 1. Digits and ASCII signs count as word bounds."""
    words = Words([b" " + r for r in raws], letters=True)
    data = words.data
    keep = np.zeros(len(data), bool)
    at, n = words.start, len(words.start)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + words.length, -1)
    keep = np.cumsum(inside[:-1]) > 0
    keep &= ~((data >= 48) & (data <= 57))
    clean = np.where(keep, data, 32)
    doc = np.searchsorted(words.at[1:], np.arange(len(data)), side="right")
    out = np.zeros(len(raws) * DIMS)
    h = np.zeros(len(data), np.uint64)
    for k in range(max(GRAMS)):
        m = len(data) - k
        h = h[:m] * np.uint64(0x100000001B3) + _BYTE[clean[k:]]
        # grams lie within one text and don't run over a gap
        ok = keep[:m] | keep[k:]
        if k:
            ok &= doc[:m] == doc[k:]
        if k >= 2:
            gap = np.concatenate([[0], np.cumsum(~keep)])
            ok &= gap[k : m + k] == gap[1 : m + 1]
        if k + 1 in GRAMS:
            b = (mix(h + np.uint64(k + 1)) & np.uint64(DIMS - 1)).astype(np.int64)
            out += np.bincount((doc[:m] * DIMS + b)[ok], minlength=len(out))
    if n:
        b = (words.hash & np.uint64(DIMS - 1)).astype(np.int64)
        out += np.bincount(doc[at] * DIMS + b, minlength=len(out))
    x = np.sqrt(out.reshape(len(raws), DIMS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 200) -> np.ndarray:
    """Linear SVM with squared hinge loss and balanced classes; accelerated gradient descent, y is +1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = z = np.zeros(x.shape[1], np.float32)
    step, t = 1 / (1 / c + 2 * 2.0), 1.0
    for _ in range(rounds):
        loss = np.maximum(0, 1 - y * (x @ z)) * weigh * y
        new = z - step * (z / c - 2 * (x.T @ loss))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, z = new, new + (was - 1) / t * (new - w)
    return w


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 500) -> Model:
    """Learn from rows with a text and a language; of each language at most ``rows_per_lang`` rows, by hash of the text.

    The sample is drawn by a hash threshold per language before it is ranked,
    so no language meets in one task. Without labelled rows the model knows
    no language and every text is ``und``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 40)))
    # a row per language: with its size known it can be broadcast, and no text is shuffled by its language
    n = small(stage(rows.groupBy("l").agg(F.count("*").alias("n")), "languages"))
    near = rows.join(n, "l").where(F.col("h") < F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(4.0 * rows_per_lang) / F.col("n")))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= rows_per_lang).select("l", "t")

    def run(batches):
        for batch in batches:
            for at, raws in steps(batch.column(1).to_pylist()):
                x = vectors(raws)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(raws)], pa.array([v.tobytes() for v in x.astype(np.float16)])], ["l", "v"])

    seen = few.mapInArrow(run, "l string, v binary").toPandas().sort_values(["l", "v"])
    if not len(seen):
        return Model()
    x = np.stack([np.frombuffer(v, np.float16) for v in seen["v"]]).astype(np.float32)
    lang = seen["l"].to_numpy()
    fam = np.array([family(v) for v in lang])
    langs, families = sorted(set(lang)), sorted(set(fam))
    planes, weights = [], []
    for f in families if len(families) > 1 else []:
        planes.append((f, ""))
        weights.append(svm(x, np.where(fam == f, 1, -1).astype(np.float32)))
    for f in families:
        for a, b in combinations([v for v in langs if family(v) == f], 2):
            own = (lang == a) | (lang == b)
            planes.append((a, b))
            weights.append(svm(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32)))
    return Model(langs, families, planes, np.stack(weights, 1) if weights else np.zeros((DIMS + 1, 0), np.float32))


def decide(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Family of the largest margin, then the most one-versus-one votes in it (ties: larger summed margins, then the name)."""
    p = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
    n = len(margins)
    if len(model.families) > 1:
        fp = p[:, : len(model.families)] / np.maximum(p[:, : len(model.families)].sum(1, keepdims=True), 1e-9)
        fam, sure = fp.argmax(1), fp.max(1)
    else:
        fam, sure = np.zeros(n, int), np.ones(n)
    lang, out = np.zeros(n, int), np.zeros(n)
    for i, f in enumerate(model.families):
        own = np.flatnonzero(fam == i)
        names = [v for v in model.langs if family(v) == f]
        votes = np.zeros((len(own), len(names)))
        for j, (a, b) in enumerate(model.planes):
            if a in names and b in names:
                q = p[own, j]
                votes[:, names.index(a)] += (q > 0.5) + 1e-3 * q
                votes[:, names.index(b)] += (q <= 0.5) + 1e-3 * (1 - q)
        win = votes.argmax(1)
        lang[own] = np.array([model.langs.index(v) for v in names])[win]
        level = np.ones(len(own))
        for j, (a, b) in enumerate(model.planes):
            if a in names and b in names:
                q = p[own, j]
                level = np.where(win == names.index(a), np.minimum(level, q), np.where(win == names.index(b), np.minimum(level, 1 - q), level))
        out[own] = sure[own] * level
    return lang, out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text alone.

    ``und`` with score 0 for a text that is null or has no letter, and for all
    texts if the model knows no language. Repeated ids give a row each.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        names = [*m.langs, UNKNOWN]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            for at, raws in steps(texts) if m.langs else ():
                x = vectors(raws)
                lang[at : at + len(raws)], score[at : at + len(raws)] = decide(x @ m.weight[:-1] + m.weight[-1], m)
            for i, text in enumerate(texts):
                if not text or not any(map(str.isalpha, text)):
                    lang[i], score[i] = len(m.langs), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in lang]), pa.array(np.clip(score, 0, 1))], [id_col, "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
