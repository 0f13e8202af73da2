"""Data health: missingness, duplicates, class balance, per-column nulls, types.

``dataset_health`` is one scan and one shuffle of row digests: rows are the same
if their 128-bit digests are, and missing and target figures are summed per
digest before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _groupable(df: DataFrame) -> DataFrame:
    """Map columns cannot be grouping keys; compare them by their JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            c = F.to_json(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def target_cast(c: Column) -> Column:
    """Integer value of a target cell, NULL when it will not convert."""
    return c.try_cast("long")


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row (128 bits); NULLs are told apart by their place."""
    cells = []
    for f in _groupable(df).schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.to_json(c) if isinstance(df.schema[f.name].dataType, T.MapType) else c
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit("NaN")).otherwise((c + F.lit(0.0)).cast("string"))
        cells += [c.isNull(), c]
    return [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit(1), *cells).alias("_h2")]


def dataset_health(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: rows, cols, missing_pct, dup_pct, target_pos_rate.

    * missing_pct — mean over columns of the missing share, ×100 (NaN is missing)
    * dup_pct     — rows beyond the first of each identical set, /rows ×100
    * target_pos_rate — mean of the integer target ×100; NULL when any value
      (a missing one included) does not convert, or when no target is given.
    Empty input gives rows 0, rates 0.0 and a NULL target rate (``cols`` kept).

    One scan; what is shuffled per distinct row is its 128-bit digest and four
    numbers, never the row.
    """
    fields = df.schema.fields
    ncols = len(fields)
    miss = [_is_missing(f).cast("long") for f in fields]
    has_target = target is not None and target in df.columns
    tv = target_cast(F.col(f"`{target}`")) if has_target else F.lit(0).cast("long")
    g = df.select(*row_digest(df), (sum(miss[1:], miss[0]) if miss else F.lit(0).cast("long")).alias("_miss"),
                  tv.alias("_t")).groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_cnt"), F.sum("_miss").alias("_miss"),
        F.count_if(F.col("_t").isNull()).alias("_bad"), F.sum("_t").alias("_tsum"))
    a = g.agg(F.sum("_cnt").alias("_n"), F.count(F.lit(1)).alias("_groups"), F.sum("_miss").alias("_missing"),
              F.sum("_bad").alias("_bad"), F.sum("_tsum").alias("_tsum"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    nonempty = n > 0
    cells = n.cast("double") * F.lit(float(max(ncols, 1)))
    if has_target:
        rate = F.when(nonempty & (F.col("_bad") == 0), F.col("_tsum").cast("double") / n * F.lit(100.0))
    else:
        rate = F.lit(None).cast("double")
    return a.select(
        n.cast("long").alias("rows"),
        F.lit(ncols).cast("int").alias("cols"),
        F.when(nonempty, F.col("_missing").cast("double") / cells * F.lit(100.0)).otherwise(F.lit(0.0)).alias("missing_pct"),
        F.when(nonempty, (n - F.col("_groups")).cast("double") / n * F.lit(100.0)).otherwise(F.lit(0.0)).alias("dup_pct"),
        rate.alias("target_pos_rate"),
    )


def missing_pct(df: DataFrame) -> DataFrame:
    """One row: mean over columns of the missing share ×100 (single aggregate, no shuffle
    beyond the one-row merge)."""
    fields = df.schema.fields
    parts = [F.count_if(_is_missing(f)) for f in fields]
    total = sum(parts[1:], parts[0])
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, total.cast("double") / (n.cast("double") * F.lit(float(len(fields))))
                         * F.lit(100.0)).otherwise(F.lit(0.0)).alias("missing_pct"))


def dup_pct(df: DataFrame) -> DataFrame:
    """One row: duplicated rows (beyond the first) as a percentage of all rows."""
    g = df.select(*row_digest(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_cnt"))
    n = F.sum("_cnt")
    return g.agg(F.coalesce(F.when(n > 0, (n - F.count(F.lit(1))).cast("double") / n * F.lit(100.0)),
                            F.lit(0.0)).alias("dup_pct"))


def target_pos_rate(df: DataFrame, target: str) -> DataFrame:
    """One row: mean of the integer target ×100, NULL if any value will not convert."""
    tv = target_cast(F.col(f"`{target}`"))
    return df.agg(F.when((F.count(F.lit(1)) > 0) & (F.count_if(tv.isNull()) == 0),
                         F.avg(tv) * F.lit(100.0)).alias("target_pos_rate"))


def health_bands(health: DataFrame) -> DataFrame:
    """Card moods: missing <5 good, <15 warn, else bad; duplicates <1, <5;
    balance good within [25, 75], else (or unknown) warn."""
    m, d, t = F.col("missing_pct"), F.col("dup_pct"), F.col("target_pos_rate")
    return health.select(
        "*",
        F.when(m < 5, "good").when(m < 15, "warn").otherwise("bad").alias("missing_mood"),
        F.when(d < 1, "good").when(d < 5, "warn").otherwise("bad").alias("dup_mood"),
        F.when(t.isNull(), "warn").when((t >= 25) & (t <= 75), "good").otherwise("warn").alias("balance_mood"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing) per column, most missing first — one aggregate, then a
    ``stack`` of the one-row result (no second scan)."""
    fields = df.schema.fields
    counts = df.agg(*[F.count_if(_is_missing(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").cast("long").alias("missing"),
                              F.lit(i).alias("_pos")) for i, f in enumerate(fields)])
    return (counts.select(F.inline(rows))
            .orderBy(F.col("missing").desc(), F.col("_pos").asc()).drop("_pos"))


def column_types(df: DataFrame) -> DataFrame:
    """Name and Spark type of every column (metadata only, no job)."""
    spark = df.sparkSession
    return spark.createDataFrame([(n, t) for n, t in df.dtypes], "column string, dtype string")


def preview(df: DataFrame, order_by: list[str], n: int = 50) -> DataFrame:
    """First ``n`` rows by a key (a top-k: each task keeps n rows, then one merge)."""
    return df.orderBy(*order_by).limit(n)
