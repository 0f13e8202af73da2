"""Parquet tables: read with NaN → NULL on every floating column.

The projection is a plain ``select`` over the scan, so columns are pruned, and
filters on whole numbers and texts reach the parquet reader.  A filter on a
floating column sits above the NaN rule; given as ``where`` it is stated on the raw
column next to its NaN guard, and the comparison itself reaches the reader.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN → NULL on float/double columns; other columns pass through untouched."""
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
            changed = True
        else:
            cols.append(F.col(f.name))
    return df.select(*cols) if changed else df


COMPARISONS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: (column, comparison, value)
Condition = tuple[str, str, object]


def where_raw(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that meet all comparisons, NaN being missing and so meeting none; ``df`` is a scan as it was read."""
    for name, sign, value in conditions:
        c = F.col(f"`{name}`")
        df = df.where(COMPARISONS[sign](c, F.lit(value)))
        # Spark takes NaN for the greatest number: these comparisons would keep it.
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) and sign in (">", ">=", "<>"):
            df = df.where(~F.isnan(c))
    return df


def read_parquet(spark: SparkSession, path: str, normalize: bool = True, where: Sequence[Condition] = ()) -> DataFrame:
    """The table at ``path``; only rows that meet all conditions of ``where``, which reach the reader."""
    df = where_raw(spark.read.parquet(path), where)
    return normalize_missing(df) if normalize else df


#: Session setting with which a caller asks for scans to be dealt over all cores.
SPREAD_SETTING = "spark.equiwatch.spreadScans"


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan's rows over all cores, e.g. of a file that has one row group."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str, normalize: bool = True,
          parallel: bool | None = None, where: Sequence[Condition] = ()) -> DataFrame:
    """One of the test tables under ``sf_dir`` (``<sf_dir>/<name>.parquet``).

    ``parallel`` (default: the session's ``SPREAD_SETTING``, off) deals its rows
    over all cores: a shuffle that pays only for a few small files of one row
    group each, so the caller has to ask for it."""
    df = read_parquet(spark, f"{sf_dir}/{name}.parquet", normalize, where)
    if parallel is None:
        parallel = spark.conf.get(SPREAD_SETTING, "false") == "true"
    return spread(df) if parallel else df
