"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

A schedule says how much a source weighs at each moment of the training, from
time 0 to 1. Its integral is the source's weight in the whole mix, and its
running integral says by when which share of the source's words is due.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .ordering import running

#: Knots (time, weight) of a weight that is linear between them and constant outside.
Schedule = Sequence[tuple[float, float]]


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(time, weight, slope, integral up to that time) of each linear piece between 0 and 1, and an end row."""
    knots = sorted((float(t), float(w)) for t, w in schedule)
    if not knots or knots[0][0] < 0 or knots[-1][0] > 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs knots with times from 0 to 1 and weights of 0 or more")
    if any(a[0] == b[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("two knots of a schedule have the same time")
    knots = [(0.0, knots[0][1])] * (knots[0][0] > 0) + knots + [(1.0, knots[-1][1])] * (knots[-1][0] < 1)
    out, total = [], 0.0
    for (t, w), (t2, w2) in zip(knots, knots[1:]):
        out.append((t, w, (w2 - w) / (t2 - t), total))
        total += (t2 - t) * (w + w2) / 2
    return [*out, (1.0, knots[-1][1], 0.0, total)]


def weight(schedule: Schedule) -> float:
    """The integral of a schedule over the training."""
    return _segments(schedule)[-1][3]


def _when_due(share: Column, schedule: Schedule) -> Column:
    """The time at which ``share`` (0 to 1) of a source's words is due: the running integral of its schedule, inverted."""
    *parts, end = _segments(schedule)
    out = F.lit(1.0)
    for t, w, slope, before in parts:
        y = share * F.lit(end[3]) - F.lit(before)
        # the root of w x + slope x^2 / 2 = y, in the form that loses no digits
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * y, F.lit(0.0)))
        x = F.when(y > 0, 2 * y / (F.lit(w) + root)).otherwise(0.0)
        out = F.when(y >= 0, F.least(F.lit(1.0), F.lit(t) + x)).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules: Sequence[Schedule] | Mapping[str, Schedule], repeats: int) -> DataFrame:
    """(source, source_size) -> and ``kind`` (which schedule), ``weight``, ``target``.

    The words of all sources are shared out by weight. A source gets at most ``repeats`` times its size; what
    is left over is shared by weight among the others, until none is above: target = min(repeats * size, level *
    weight), and the level is found by one pass over the sources in the order in which they fill up.
    """
    named = isinstance(schedules, Mapping)
    kinds = list(schedules.values()) if named else list(schedules)
    ranked = running(sizes, [], [F.col("source").asc_nulls_last()], rank=F.lit(1))
    if named:
        kind = F.lit(None).cast("int")
        for i, name in enumerate(schedules):
            kind = F.when(F.col("source") == name, i).otherwise(kind)
    else:
        kind = (F.col("rank") % len(kinds)).cast("int")
    w = F.lit(0.0)
    for i, s in enumerate(kinds):
        w = F.when(F.col("kind") == i, F.lit(weight(s))).otherwise(w)
    x = ranked.withColumn("kind", kind).withColumn("weight", w).withColumn("full", F.lit(repeats) * F.col("source_size"))
    # a source is full at level full / weight; before it in this order stand those that fill up sooner
    x = x.withColumn("at", F.when(F.col("weight") > 0, F.col("full") / F.col("weight")))
    x = stage(running(x, [], [F.col("at").asc_nulls_last(), F.col("source").asc_nulls_last()], full_before=F.col("full"), weight_before=F.col("weight")), "sources")
    whole = x.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, weights = F.lit(whole.words), F.lit(whole.weights)
    reached = F.col("full_before") + F.col("at") * (weights - F.col("weight_before")) >= words
    at = (words - F.col("full_before")) / (weights - F.col("weight_before"))
    level = x.where("weight > 0").where(reached).agg(F.min_by(at, "weight_before")).first()[0]
    full = F.col("full").cast("double")
    mine = F.when(F.col("weight") <= 0, 0.0).otherwise(full if level is None else F.least(full, F.lit(level) * F.col("weight")))
    return x.select("source", "source_size", "kind", "weight", mine.alias("target"))


def _with_goal(x: DataFrame, goal: DataFrame, most: int = 16 << 20, salts: int = 16) -> DataFrame:
    """Each row beside its source's row of ``goal``: broadcast if that takes ``most`` bytes at most, else joined by source and a salt."""
    size = goal.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("_source"))
    if size <= most:
        return x.join(F.broadcast(goal), same).drop("_source")
    goal = goal.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.withColumn("_s", F.pmod("h", F.lit(salts)).cast("int")).join(goal, same & F.col("_s").eqNullSafe(F.col("_salt"))).drop("_source", "_salt", "_s")


def mix(docs: DataFrame, length: Column, schedules: Sequence[Schedule] | Mapping[str, Schedule], id_col: str = "doc_id", source_col: str = "source", repeats: int = 3, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, taken, position, copies): the mix, range-sorted by position.

    ``schedules`` are dealt to the sources in code point order (null last), repeating, or named by source; a source
    that isn't named is left out of the mix. A source's documents, in the order of a hash of id and ``seed``, form a
    stream of words that starts anew up to ``repeats`` times. The mix takes the stream's first ``target`` words
    (rounded), so at most one copy of a source is taken in part. The copy that starts at word x of the stream stands where
    the running integral of the source's schedule reaches x / target of its whole. ``copies`` lists them:
    struct<copy, start, words, position>; ``position`` is the first one's, null if nothing is taken.

    Texts are read once for their ``length``. Everything else is sums and windows over rows of numbers,
    partitioned by ranges, so that no source meets in one task.

    Null and empty texts have size 0 and are listed with nothing taken. A null source is a source of its own. Repeated
    ids: each row is a document. Rows that are equal in id, source and size are interchangeable. Null ids come
    first in their source. An empty table gives an empty result. Other columns are not read.
    """
    kinds = list(schedules.values()) if isinstance(schedules, Mapping) else list(schedules)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(length, F.lit(0)).cast("long").alias("size"))
    rows = stage(rows.withColumn("h", h).withColumn("salt", F.monotonically_increasing_id()), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(sizes, schedules, repeats), "targets").withColumnRenamed("source", "_source")
    # the salt parts rows that repeat one id; it decides only between rows that are equal
    order = [F.col("h").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("size"), F.col("salt")]
    x = running(rows, ["source"], order, before=F.col("size"))
    x = _with_goal(x, goal)
    due = F.lit(None).cast("double")
    copies = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda j: F.struct(
        j.alias("copy"), (j * F.col("source_size") + F.col("before")).alias("start"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5).cast("long") - (j * F.col("source_size") + F.col("before")))).cast("long").alias("words")))
    x = x.withColumn("c", F.filter(copies, lambda c: c["words"] > 0))

    def timed(c: Column) -> Column:
        out = due
        for i, s in enumerate(kinds):
            if weight(s) > 0:
                out = F.when(F.col("kind") == i, _when_due(c["start"] / F.col("target"), s)).otherwise(out)
        return F.struct(c["copy"].alias("copy"), c["start"].alias("start"), c["words"].alias("words"), out.alias("position"))

    x = x.withColumn("copies", F.transform("c", timed))
    taken = F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = x.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"), "copies")
    return out.orderBy(F.asc_nulls_last("position"), F.asc_nulls_first(id_col), "size", F.asc_nulls_last(source_col))


def training_order(mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, copy, start, words, position, offset): the copies of a mix in training order, ``offset`` words after its start."""
    each = mixed.select(id_col, source_col, F.inline("copies"))
    order = [F.col("position"), F.asc_nulls_last(source_col), F.col("start")]
    return running(each, [], order, offset=F.col("words")).orderBy(*order)
