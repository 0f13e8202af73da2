"""Attach one-row aggregates (thresholds, shares, counts) to every row.

The whole one-row frame becomes a single scalar subquery over a struct, and its
columns are fields of that struct: however many columns are used, Spark runs the
aggregate once (equal subqueries are reused) and no join of any kind is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus one column per column of ``one_row`` (an aggregate with no keys)."""
    names = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_constants")).scalar()
    return df.select("*", *[packed.getField(c).alias(c) for c in names])
