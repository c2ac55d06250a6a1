"""Results that are computed per scope and only where the scope's inputs have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import versions


class Changed(RuntimeError):
    """The inputs changed while they were worked on; nothing was published."""


def fingerprints(rows: DataFrame, scope: str, *cols: str) -> DataFrame:
    """(scope, fingerprint): a hash of each scope's rows whatever their order; sums of row hashes, so they combine before the shuffle."""
    h = F.xxhash64(*cols)
    sums = [F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(7)).cast("decimal(38,0)"))]
    return rows.groupBy(F.col(scope).cast("string").alias("scope")).agg(F.sha2(F.concat_ws("|", *[s.cast("string") for s in sums]), 256).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(scope, state): new, changed, unchanged or gone, of two tables of fingerprints."""
    x = now.select("scope", F.col("fingerprint").alias("_n")).join(before.select("scope", F.col("fingerprint").alias("_b")), "scope", "full")
    return x.select("scope", F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_n") == F.col("_b"), "unchanged").otherwise("changed").alias("state"))


def refresh(read_inputs: Callable[[], DataFrame], scope: str, cols: list[str], compute: Callable[[DataFrame], DataFrame], path: str, run: int, settings: str = "") -> dict[str, int]:
    """Bring the results at ``path`` up to date; returns how many scopes were computed, kept and dropped.

    ``read_inputs`` gives the inputs as they are when it is called. Scopes (formats, branches: few) whose rows or ``settings`` differ from those of the
    published results are computed anew by ``compute``, which keeps the scope's column; others aren't read for it. All are published together. Before that,
    fingerprints are taken again: if the inputs changed meanwhile, ``Changed`` is raised and the former results stay.
    """
    rows = read_inputs()
    spark = rows.sparkSession
    take = lambda df: {r.scope: f"{r.fingerprint}|{settings}" for r in fingerprints(df, scope, *cols).where("scope IS NOT NULL").collect()}
    now, before = take(rows), versions.manifest(spark, path)["notes"]
    due = sorted(s for s in now if before.get(s) != now[s])
    gone = sorted(s for s in before if s not in now)
    if due or gone:
        part = rows.where(F.col(scope).cast("string").isin(due))
        result = compute(part)

        def same_inputs(_: DataFrame) -> DataFrame:
            later = take(read_inputs())
            if any(later.get(s) != now[s] for s in due) or set(later) != set(now):
                raise Changed("inputs changed during the run")
            return result.limit(0)

        # a scope without results has no rows to replace its former ones, so those go by name
        versions.publish(result, path, scope, ("refresh", run), 0, 0.0, [same_inputs], [*gone, *due], {s: now[s] for s in due})
    return {"computed": len(due), "kept": len(now) - len(due), "dropped": len(gone)}
