"""Contractors of price formats from a sheet: holdings, their parties, the parties' delivery points, and who gets which format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .uploads import insert_missing

# Names where a cell is blank.
NO_HOLDING = "Без холдинга"
NO_PARTY = "Не указан"

SCHEMAS = {
    "formats": "format string, branch string", "holdings": "holding string, branch string", "parties": "party string, branch string, holding string",
    "points": "point string, party string, branch string", "links": "format string, party string, branch string, point string, holding string",
}
KEYS = {"formats": ["format"], "holdings": ["holding"], "parties": ["party", "branch"], "points": ["point", "party", "branch"], "links": ["format", "party", "branch", "point"]}


def load(rows: DataFrame, existing: dict[str, DataFrame], order: str = "_row") -> dict[str, DataFrame]:
    """The five tables of ``SCHEMAS`` after the import of rows (format, branch, holding, party, point, and their order).

    What is there stays as it is; of what is new the first row says its branch and holding. A row without a format is left
    out. The branch is the format's, the row's own only where it brings a new format. A party is known by name and branch, a point by name and
    party, a holding by name. A row without a point links the party as a whole: its point is empty.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    x = rows.select(text("format").alias("format"), text("branch").alias("branch"), text("holding").alias("holding"), text("party").alias("party"), text("point").alias("point"), F.col(order).alias("_o"))
    x = x.where("format <> ''").withColumns({"holding": F.when(F.col("holding") != "", F.col("holding")).otherwise(NO_HOLDING), "party": F.when(F.col("party") != "", F.col("party")).otherwise(NO_PARTY)})
    spark = rows.sparkSession
    old = {k: existing[k].select(*[c.split()[0] for c in s.split(", ")]) if k in existing else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    first = F.asc("_o")
    out = {"formats": insert_missing(old["formats"], x, ["format"], first)}
    x = x.drop("branch").join(out["formats"], "format")
    out["holdings"] = insert_missing(old["holdings"], x, ["holding"], first)
    out["parties"] = insert_missing(old["parties"], x, KEYS["parties"], first)
    out["points"] = insert_missing(old["points"], x.where("point <> ''"), KEYS["points"], first)
    out["links"] = insert_missing(old["links"], x, KEYS["links"], first)
    return out


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows that refer to a party, holding or format that isn't there; none after ``load``."""
    lost = {
        "parties": tables["parties"].join(tables["holdings"].select("holding"), "holding", "left_anti"),
        "points": tables["points"].join(tables["parties"].select("party", "branch"), ["party", "branch"], "left_anti"),
        "links": tables["links"].join(tables["formats"].select("format"), "format", "left_anti"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in lost.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
