"""Line dedup by winnowing over line hashes; DataFrame functions only.

A passage is a run of whole lines. The first occurrence of a repeated passage
stays, later ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Delete every run of lines of at least ``min_words`` words that stands earlier too.

    Earlier means in a document with a smaller id, or further up in the same
    one. Lines compare without the white space around them; empty lines neither
    break nor extend a run, are never deleted and count no words.

    1. A gram is the shortest run of lines from a given line that has half of
       ``min_words``. From each line on, the smallest gram hash among those
       that start within the next half is a fingerprint. A run of ``min_words``
       words holds all grams of the window at its first line, so both of its
       occurrences yield the same fingerprint.
    2. A window is the shortest run of ``min_words`` words from a given line on,
       or up to a given line. Each run of that many words is the union of the
       windows inside it, and at every place where its lines stand they are
       windows too. A window is looked up only if its fingerprint stands in two
       places at least.
    3. Of equal windows all but the first go, whatever stands around them. That
       is linear in the windows, however often a passage occurs.

    The first occurrence of a line never goes: what is deleted has an equal
    earlier line. Null and empty texts and texts without repeats come back as
    they are; a text of which all lines go comes back empty. Rows with a null
    id come back unchanged. Rows that repeat an id and its text are copies of one document:
    their lines are read once. Rows of one id with other texts are documents of their own, in the order of the texts' hashes. Returns (id, text, n_lines, n_removed).
    """
    half = (min_words + 1) // 2
    docs = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("x"), F.col(f"`{text_col}`").alias("t"))
    lines = docs.where("d IS NOT NULL AND t IS NOT NULL").select(
        "d", "x", F.posexplode(F.transform(F.split("t", "\n", -1), lambda x: F.struct(F.xxhash64(F.trim(F.regexp_replace(x, r"[\t\r ]+", " "))).alias("h"), F.size(F.filter(F.split(F.trim(F.regexp_replace(x, r"[\t\r ]+", " ")), " ", -1), lambda y: y != "")).alias("w")))).alias("p", "l")
    ).where("l.w > 0").select("d", "x", "p", "l.h", "l.w")
    by = Window.partitionBy("d", "x").orderBy("p")
    ahead = Window.partitionBy("d", "x").orderBy("s").rangeBetween(0, half - 1)
    full = Window.partitionBy("d", "x").orderBy("s").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("d", "x").orderBy("e").rangeBetween(1 - min_words, 0)
    gram = (
        lines.dropDuplicates(["d", "x", "p"])
        .withColumn("e", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("s", F.col("e") - F.col("w"))
        .withColumn("hs", F.collect_list("h").over(ahead))
        .withColumn("g", F.when(F.sum("w").over(ahead) >= half, F.xxhash64("hs")))
        .withColumn("pick", F.min(F.when(F.col("g").isNotNull(), F.struct("g", "p"))).over(ahead))
        .withColumn("n", F.sum("w").over(full))
        .withColumn("fore", F.when(F.col("n") >= min_words, F.struct("pick", F.col("p").alias("a"), F.last("p").over(full).alias("b"), F.xxhash64(F.collect_list("h").over(full)).alias("k"))))
    )
    # a window up to a line that is also the one from its first line on is taken once
    up = F.sum("w").over(back)
    till = F.when((up >= min_words) & (F.first("n").over(back) < up), F.struct(F.first("pick").over(back).alias("pick"), F.first("p").over(back).alias("a"), F.col("p").alias("b"), F.xxhash64(F.collect_list("h").over(back)).alias("k")))
    found = stage(
        gram.select("d", "x", "fore", till.alias("till"))
        .select("d", "x", F.explode(F.filter(F.array("fore", "till"), lambda f: f.isNotNull())).alias("f"))
        .select("d", "x", F.col("f.pick.g").alias("g"), F.col("f.pick.p").alias("i"), "f.a", "f.b", "f.k"),
        "windows",
    )
    again = found.groupBy("g").agg(F.min(F.struct("d", "x", "i")).alias("lo"), F.max(F.struct("d", "x", "i")).alias("hi")).where("lo <> hi").select("g")
    windows = found.join(again, "g", "left_semi")
    first = windows.groupBy("g", "k").agg(F.min(F.struct("d", "x", "a")).alias("o"), F.count("*").alias("n")).where("n > 1").select("g", "k", "o")
    later = windows.join(first, ["g", "k"]).where(F.col("o") < F.struct("d", "x", "a")).select("d", "x", "a", "b")
    # windows that overlap become one run
    inside = Window.partitionBy("d", "x").orderBy("a", "b")
    dead = (
        later.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        .withColumn("run", F.sum(F.col("new").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("d", "x", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .groupBy("d", "x").agg(F.collect_list(F.struct("a", "b")).alias("dead"))
    )
    # a one-row generator, so that the lines are split once and then looked up by place
    y = docs.join(dead, ["d", "x"], "left").select("d", "t", "dead", F.inline(F.array(F.struct(F.split("t", "\n", -1).alias("ls")))))
    blank = lambda i: F.trim(F.regexp_replace(F.get("ls", i), r"[\t\r ]+", " ")) == ""
    gone = F.filter(F.flatten(F.transform("dead", lambda r: F.sequence(r["a"], r["b"]))), lambda i: ~blank(i))
    y = y.select("d", "t", "ls", F.inline(F.array(F.struct(gone.alias("gone")))))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone"), lambda i: F.get("ls", i)), "\n")
    return y.select(
        F.col("d").alias(id_col), F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias(text_col),
        F.when(F.col("t").isNull(), 0).otherwise(F.size("ls")).alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).alias("n_removed"),
    )
