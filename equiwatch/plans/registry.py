"""Registry of named queries: Spark plan builder + (optional) DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    survey_id: str


_QUERIES: dict[str, Query] = {}


def register(name: str, survey_id: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = Query(name, fn, sql, survey_id)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: equal values, equal text)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def all_queries() -> dict[str, Query]:
    # Import the query modules for their registration side effect.
    from . import (q_fairness, q_health, q_cleaning, q_labels, q_sampling,  # noqa: F401
                   q_models, q_streaming, q_io, q_metrics, q_names)
    return dict(_QUERIES)
