"""Columns that are computed once a row, whatever reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fix(rows: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once: a later filter, projection or lambda can't inline their expressions, which
    would multiply along a cascade. It is a one-row generator, within the same stage's code."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
