"""Exponential smoothing of per-batch series: s₁ = v₁, sₜ = α·vₜ + (1−α)·sₜ₋₁.

A stretch of a series maps the smoothed value before it to the one after it,
``x → (1−α)^k·x + B``, where ``k`` counts its values; if there was none before, the
stretch's first value stands for ``x``, as s₁ = v₁ asks.  Such maps compose, so the
recurrence is evaluated exactly without gathering a series anywhere:

* rows are range-partitioned and sorted by series and step (steps may start
  anywhere and have gaps; ``step`` may be several columns, e.g. run and batch);
* each partition works through its rows in a stream of Arrow batches, and within
  ``block`` rows composes all prefixes at once by doubling;
* the last map of each series in each partition is one small row; prefixes of
  these are composed by doubling too, with window lags;
* a row's map is applied to what its partition was handed.

A NULL or NaN value leaves the smoothed value as it was (NULL before the first value).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import _bounded, _changes, _cols, _ordered, _same_run, materialize

BLOCK = 4096


def smooth_block(values: pd.DataFrame, alpha: float, carry: Sequence[float | None]) -> pd.DataFrame:
    """The recurrence over consecutive rows, from the smoothed values ``carry`` (None: nothing before)."""
    seed = pd.DataFrame([list(carry)], columns=values.columns, dtype="float64")
    return pd.concat([seed, values.astype("float64")]).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().iloc[1:]


def _prefix_maps(v: np.ndarray, known: np.ndarray, begin: np.ndarray, alpha: float):
    """Of every row: ``k``, ``B`` and first value of its series' rows up to it; ``begin`` is the place where these start."""
    n = len(v)
    place = np.arange(n)
    counted = np.cumsum(known)
    k = counted - (counted[begin] - known[begin])
    factor, shift = np.where(known, 1.0 - alpha, 1.0), np.where(known, alpha * v, 0.0)
    reach = 1
    while reach < n:
        on = np.flatnonzero(place - reach >= begin)
        if not len(on):
            break
        shift[on] = factor[on] * shift[on - reach] + shift[on]
        factor[on] = factor[on] * factor[on - reach]
        reach *= 2
    # the first known row at or after the beginning, if it is not beyond the row
    following = np.minimum.accumulate(np.where(known, place, n)[::-1])[::-1]
    first = np.where(k > 0, v[np.minimum(following[begin], n - 1)], 0.0)
    return k, shift, first


def ema(df: DataFrame, values: Sequence[str], step: str | Sequence[str] = "batch", series: Sequence[str] = (),
        alpha: float = 0.25, block: int = BLOCK, suffix: str = "_smoothed", partitions: int | None = None) -> DataFrame:
    """``df`` with a smoothed column per value; ``alpha`` in (0, 1]."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    keep, values, series = 1.0 - float(alpha), list(values), list(series)
    steps = [step] if isinstance(step, str) else list(step)
    made = df.select("*", *[F.col(f"`{v}`").cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    ranged = _ordered(made, [*_cols([f"`{s}`" for s in series]), *_cols([f"`{s}`" for s in steps])], partitions)
    tagged = ranged.withColumn("_pid", F.spark_partition_id())
    at, series_at = len(df.columns), [df.columns.index(s) for s in series]
    schema = T.StructType([*tagged.schema.fields, T.StructField("_at", T.LongType()), *(
        f for i in range(len(values)) for f in (T.StructField(f"_k{i}", T.LongType()), T.StructField(f"_b{i}", T.DoubleType()),
                                                T.StructField(f"_f{i}", T.DoubleType())))])

    def run(batches):
        last, carry, rows = None, None, 0
        for whole in batches:
            for lo in range(0, len(whole), block):
                b = whole.slice(lo, block)
                n = len(b)
                own = [b.column(i) for i in series_at]
                first, end = ([c[k].as_py() for c in own] for k in (0, n - 1))
                if last is None or first != last:
                    carry = [(0, 0.0, 0.0)] * len(values)
                last = end
                starts = np.concatenate(([0], np.flatnonzero(_changes(own)) + 1)) if own else np.zeros(1, np.int64)
                begin = np.repeat(starts, np.diff(np.append(starts, n)))
                head = begin == 0  # rows of the series that came over
                arrays = [*b.columns, pa.array(np.arange(rows, rows + n))]
                rows += n
                for i in range(len(values)):
                    v = b.column(at + i).to_numpy(zero_copy_only=False)
                    known = ~np.isnan(v)
                    k, shift, found = _prefix_maps(np.where(known, v, 0.0), known, begin, alpha)
                    k0, shift0, found0 = carry[i]
                    shift[head] += keep ** k[head] * shift0
                    k[head] += k0
                    if k0:
                        found[head] = found0
                    carry[i] = int(k[-1]), float(shift[-1]), float(found[-1])
                    arrays += [pa.array(k), pa.array(shift), pa.array(found)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    local = materialize(tagged.mapInArrow(run, schema))
    parts = [f"_{c}{i}" for i in range(len(values)) for c in "kbf"]
    ends = local.groupBy("_pid", *[f"`{s}`" for s in series]).agg(
        F.max_by(F.struct(*parts), F.col("_at")).alias("_m")).select("_pid", *[f"`{s}`" for s in series], "_m.*")
    w = Window.partitionBy(*[f"`{s}`" for s in series]).orderBy("_pid")
    reach, most = 1, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while reach < most:
        before = {c: F.lag(c, reach).over(w) for c in parts}
        composed = []
        for i in range(len(values)):
            k, b, f = f"_k{i}", f"_b{i}", f"_f{i}"
            composed += [(F.coalesce(before[k], F.lit(0)) + F.col(k)).alias(k),
                         (F.pow(F.lit(keep), F.col(k).cast("double")) * F.coalesce(before[b], F.lit(0.0)) + F.col(b)).alias(b),
                         F.when(before[k] > 0, before[f]).otherwise(F.col(f)).alias(f)]
        ends = ends.select("_pid", *[f"`{s}`" for s in series], *composed)
        reach *= 2
    handed = [F.lag(c, 1).over(w).alias(f"{c}_in") for c in parts]
    offsets = ends.select(F.col("_pid").alias("_opid"), *[F.col(f"`{s}`").alias(f"_o_{s}") for s in series], *handed)
    joined = local.join(_bounded(offsets, ends, series), _same_run(series))
    smoothed = []
    for i, v in enumerate(values):
        k, b, f = (F.col(f"_{c}{i}") for c in "kbf")
        k_in, b_in, f_in = (F.col(f"_{c}{i}_in") for c in "kbf")
        faded = F.pow(F.lit(keep), k.cast("double"))
        into = F.pow(F.lit(keep), k_in.cast("double")) * f_in + b_in
        smoothed.append(F.when(k_in > 0, faded * into + b).when(k > 0, faded * f + b).alias(f"{v}{suffix}"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *smoothed)
