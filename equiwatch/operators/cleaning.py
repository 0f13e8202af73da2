"""Fitted type cleaning: one aggregate decides a rule per text column, then a
pure projection applies it (to this frame and to any later batch).

Rules, in order, for every string column:

* ``boolish`` — more than 60% of *all* rows (missing in the denominator) are in
  the truthy/falsy sets after trim+lower → 1/0, other values NULL;
* ``numeric`` — else, at least 70% of all rows parse as a number once ``$``,
  ``,`` and ``%`` are removed → double, others NULL;
* ``keep`` — otherwise unchanged.

Datetime columns become epoch seconds (double).  The fit is a single global
aggregate (partial aggregation per task, a one-row merge), whatever the size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (NUMERIC_PATTERN, boolish_value, is_boolish, parse_number,
                                 sanitize_nonfinite, strip)

BOOLISH_SHARE = 0.6     # strictly more than this share → boolish
NUMERIC_SHARE = 0.7     # at least this share → numeric


def epoch_seconds_of(c: Column, dtype: T.DataType) -> Column:
    """Seconds since 1970-01-01 as double.  ``timestamp_ntz`` is read as UTC wall
    time without consulting the session zone; NULL stays NULL."""
    if isinstance(dtype, T.TimestampNTZType):
        micros = (F.unix_date(c.cast("date")).cast("long") * F.lit(86400000000)
                  + F.hour(c).cast("long") * F.lit(3600000000)
                  + F.minute(c).cast("long") * F.lit(60000000)
                  + (F.date_part(F.lit("SECOND"), c) * F.lit(1000000)).cast("long"))
        return micros.cast("double") / F.lit(1e6)
    if isinstance(dtype, T.DateType):
        return (F.unix_date(c).cast("long") * F.lit(86400)).cast("double")
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(1e6)


def datetime_to_epoch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every (or the given) timestamp/date column → epoch seconds."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, kinds)}
    return df.select(*[epoch_seconds_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                       if f.name in targets else F.col(f"`{f.name}`") for f in df.schema.fields])


@dataclass
class CleaningRules:
    """The fitted decision per column (``boolish`` / ``numeric`` / ``keep`` / ``epoch``)."""

    rules: dict[str, str] = field(default_factory=dict)
    dtypes: dict[str, T.DataType] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            rule = self.rules.get(f.name, "keep")
            if rule == "boolish":  # rows that are clean already pass through
                cols.append((boolish_value(c) if isinstance(f.dataType, T.StringType) else c.cast("int")).alias(f.name))
            elif rule == "numeric":
                cols.append((parse_number(c) if isinstance(f.dataType, T.StringType) else c.cast("double")).alias(f.name))
            elif rule == "epoch":
                cols.append((c if isinstance(f.dataType, T.DoubleType) else epoch_seconds_of(c, f.dataType)).alias(f.name))
            else:
                cols.append(c)
        return df.select(*cols)


def share_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``<c>__bool`` and ``<c>__num`` shares for every text column."""
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs.append(F.avg(is_boolish(col).cast("double")).alias(f"b{i}"))
        aggs.append(F.avg(parse_number(col).isNotNull().cast("double")).alias(f"n{i}"))
    return df.agg(*aggs)


def fit_cleaning(df: DataFrame, columns: Sequence[str] | None = None) -> CleaningRules:
    """Decide the rule per column with one aggregate (a one-row collect)."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wanted = set(df.columns if columns is None else columns)
    text_cols = [c for c in text_cols if c in wanted]
    rules: dict[str, str] = {}
    for f in df.schema.fields:
        if f.name in wanted and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            rules[f.name] = "epoch"
    if text_cols:
        row = share_stats(df, text_cols).first()
        for i, c in enumerate(text_cols):
            b, n = row[f"b{i}"], row[f"n{i}"]
            if b is not None and b > BOOLISH_SHARE:
                rules[c] = "boolish"
            elif n is not None and n >= NUMERIC_SHARE:
                rules[c] = "numeric"
            else:
                rules[c] = "keep"
    return CleaningRules(rules, {f.name: f.dataType for f in df.schema.fields})


def clean_lazy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same decision without leaving the plan: the one-row share aggregate is
    read as scalar subqueries and each column picks its rule with ``CASE``;
    output type is double for every cleaned column."""
    from .constants import with_constants
    stats = share_stats(df, columns)
    j = with_constants(df, stats)
    out = []
    keep = set(columns)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in keep:
            i = list(columns).index(f.name)
            b, n = F.col(f"b{i}"), F.col(f"n{i}")
            out.append(F.when(b > F.lit(BOOLISH_SHARE), boolish_value(c).cast("double"))
                        .when(n >= F.lit(NUMERIC_SHARE), parse_number(c))
                        .otherwise(F.lit(None).cast("double")).alias(f"{f.name}__num"))
            out.append(F.when((b <= F.lit(BOOLISH_SHARE)) & (n < F.lit(NUMERIC_SHARE)), c)
                       .alias(f"{f.name}__text"))
        else:
            out.append(c)
    return j.select(*out)


def label_to_int(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Target → int: boolish map if the column is more than 60% boolish, else a
    plain number (not symbol-stripped); missing → 0; fractions truncated."""
    c = F.col(f"`{column}`")
    stats = df.agg(F.avg(is_boolish(c).cast("double")).alias("_bshare"))
    plain = strip(c.cast("string"))
    number = F.when(plain.rlike(NUMERIC_PATTERN), plain.try_cast("double"))
    val = F.when(F.col("_bshare") > F.lit(BOOLISH_SHARE), boolish_value(c).cast("double")).otherwise(number)
    from .constants import with_constants
    return (with_constants(df, stats)
            .withColumn(out or column, F.coalesce(val, F.lit(0.0)).cast("int"))
            .drop("_bshare"))


#: Texts accepted in a binary target column; fixed values.
BINARY_TEXTS = ("0", "1", "True", "False")


def target_accepted(df: DataFrame, column: str) -> Column:
    """Whether a cell is missing (NaN included) or a binary value: 0/1, a boolean, or one of ``BINARY_TEXTS``."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.lit(True)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c) | c.isin(0.0, 1.0)
    if isinstance(kind, T.NumericType):
        return c.isNull() | c.isin(0, 1)
    if isinstance(kind, T.StringType):
        return c.isNull() | c.isin(*BINARY_TEXTS)
    return c.isNull()


def binary_target_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per target column: rows that aren't binary, the least such value, and whether the column is binary.

    One aggregate over all columns; missing values are left out, as they are before training.
    """
    aggs = []
    for i, name in enumerate(columns):
        bad = ~target_accepted(df, name)
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, F.col(f"`{name}`").cast("string"))).alias(f"v{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("target"), F.col(f"n{i}").alias("n_other"), F.col(f"v{i}").alias("example"),
                              (F.col(f"n{i}") == 0).alias("is_binary")) for i, name in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(rows))


def binary_target_check(df: DataFrame, *columns: str) -> None:
    """Raise unless the non-missing values of the targets are binary (see ``target_accepted``)."""
    for r in binary_target_report(df, columns).where(~F.col("is_binary")).collect():
        raise ValueError(f"target {r['target']!r} is not binary: {r['example']!r} and others in {r['n_other']} rows")


def sanitize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN/±inf → 0 in the given numeric columns."""
    keep = set(columns)
    return df.select(*[sanitize_nonfinite(F.col(f"`{f.name}`")).alias(f.name) if f.name in keep
                       else F.col(f"`{f.name}`") for f in df.schema.fields])
