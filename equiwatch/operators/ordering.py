"""Scalable global order: row numbers, ranks within a few groups, running sums.

An unpartitioned ``row_number() OVER (ORDER BY …)`` moves every row into one
task.  Instead:

1. ``repartitionByRange`` on the sort key (Spark samples the key to choose
   balanced bounds; a hot key value is split across partitions by the
   remaining key columns), then ``sortWithinPartitions``;
2. tag every row with its partition id and ``monotonically_increasing_id``
   (consecutive inside a partition) and cut the lineage with a *reliable*
   ``checkpoint`` in ``spark.checkpoint.dir`` — recomputation after an executor
   loss then reads the same files, so ids stay stable;
3. count rows per partition (and group): at most ``partitions + groups`` rows;
   running totals over that small table give each partition's offset, which is
   broadcast back (its size is bounded by the partition count, not the data).

The total work is one range shuffle, one write, and narrow scans.

``running_sums`` adds values up along such an order: each range partition runs its
own totals in a stream of Arrow batches, and the totals of the partitions before,
one row per (partition, group), are added.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, scratch_path


MAX_BROADCAST_RUNS = 1_000_000


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared checkpoint folder (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: like ``materialize``, but later passes read only the columns they use."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ordered(df: DataFrame, keys: Sequence[Column], partitions: int | None) -> DataFrame:
    """``df`` in range partitions, sorted within them."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def _bounded(offsets: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per partition, and per (partition, group) run if there are groups: broadcast while that is small."""
    if not groups or stats.limit(MAX_BROADCAST_RUNS + 1).count() <= MAX_BROADCAST_RUNS:
        return F.broadcast(offsets)
    return offsets


def _same_run(groups: Sequence[str]) -> Column:
    same = F.col("_pid") == F.col("_opid")
    for g in groups:  # a NULL group is a group like any other
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"`_o_{g}`"))
    return same


def global_rank(df: DataFrame, order_by: Sequence[str | Column], out: str = "row_id",
                groups: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Add a 1-based position in ``order_by`` order (restarting per ``groups``).

    ``order_by`` should form a total order (add the row key) for results that do
    not depend on tie order.  ``groups`` must have few distinct values (classes,
    column names): the offset table holds one row per (partition, group) run.
    """
    ranged = _ordered(df, [*_cols(groups), *_cols(order_by)], partitions)
    tagged = materialize(ranged.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    stats = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_cnt"),
                                                F.min("_mid").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("_pid", *groups, "_first",
                           F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"))
    offsets = offsets.select(F.col("_pid").alias("_opid"), *[F.col(f"`{g}`").alias(f"_o_{g}") for g in groups],
                             "_first", "_before")
    joined = tagged.join(_bounded(offsets, stats, groups), _same_run(groups)).drop("_opid", *[f"_o_{g}" for g in groups])
    return (joined.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_before"))


def _changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row (but the first) differs in any of the columns from the one before; nulls are equal."""
    n = len(columns[0])
    out = np.zeros(max(0, n - 1), bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out |= codes[1:] != codes[:-1]
    return out


def _run_totals(x: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
    """Running totals that begin anew at every start (the first row is one, going on from ``carry``)."""
    if x.dtype.kind == "i" and np.abs(x).sum(dtype=float) + abs(float(carry)) >= 2.0 ** 63:
        raise OverflowError("a running sum leaves the range of bigint")
    total = np.empty_like(x)
    for lo, hi in zip(starts, np.append(starts[1:], len(x)), strict=True):
        np.cumsum(x[lo:hi], out=total[lo:hi])
    total[:starts[1] if len(starts) > 1 else len(x)] += carry
    return total


def running_sums(df: DataFrame, order_by: Sequence[str | Column], values: dict[str, str | Column],
                 groups: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with a column per entry of ``values``: the sum of its expression up to and with the row, in ``order_by`` order.

    Sums restart per ``groups`` (few distinct values).  Whole numbers add up exactly as
    ``bigint``, others as ``double``.  NULL adds nothing, and a sum is NULL until there is
    a value, as in SQL's ``ROWS UNBOUNDED PRECEDING``.  A total order makes the result
    independent of how ties fall.
    """
    names, groups = list(values), list(groups)
    made = df.select("*", *[c.alias(f"_v{i}") for i, c in enumerate(_cols(list(values.values())))])
    whole = [isinstance(made.schema[f"_v{i}"].dataType, T.IntegralType) for i in range(len(names))]
    made = made.select(*[F.col(f"`{c}`") for c in df.columns], *[
        F.col(f"_v{i}").cast("bigint" if w else "double").alias(f"_v{i}") for i, w in enumerate(whole)])
    tagged = _ordered(made, [*_cols(groups), *_cols(order_by)], partitions).withColumn("_pid", F.spark_partition_id())
    at = len(df.columns)
    group_at = [df.columns.index(g) for g in groups]
    schema = T.StructType([*tagged.schema.fields, *(f for i, w in enumerate(whole) for f in (
        T.StructField(f"_s{i}", T.LongType() if w else T.DoubleType()), T.StructField(f"_n{i}", T.LongType())))])

    def run(batches):
        last, carry = None, None
        for b in batches:
            n = len(b)
            if not n:
                continue
            own = [b.column(i) for i in group_at]
            first, end = ([c[k].as_py() for c in own] for k in (0, n - 1))
            if last is None or first != last:
                carry = [0] * (2 * len(names))
            starts = np.concatenate(([0], np.flatnonzero(_changes(own)) + 1)) if own else np.zeros(1, np.int64)
            last, arrays = end, list(b.columns)
            for i in range(len(names)):
                column = b.column(at + i)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                x = column.fill_null(0).to_numpy(zero_copy_only=False)
                for k, (v, type_) in enumerate(((x, column.type), (known.astype(np.int64), pa.int64()))):
                    total = _run_totals(v, starts, carry[2 * i + k])
                    carry[2 * i + k] = total[-1]
                    arrays.append(pa.array(total, type_))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    local = materialize(tagged.mapInArrow(run, schema))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = local.groupBy("_pid", *groups).agg(*[a for i in range(len(names)) for a in (
        F.sum(f"_v{i}").alias(f"_t{i}"), F.count(f"_v{i}").alias(f"_k{i}"))])
    offsets = stats.select(F.col("_pid").alias("_opid"), *[F.col(f"`{g}`").alias(f"_o_{g}") for g in groups], *[
        F.coalesce(F.sum(f"_{c}{i}").over(w), F.lit(0)).alias(f"_{c}{i}") for i in range(len(names)) for c in "tk"])
    joined = local.join(_bounded(offsets, stats, groups), _same_run(groups))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[
        F.when(F.col(f"_n{i}") + F.col(f"_k{i}") > 0, F.col(f"_s{i}") + F.col(f"_t{i}")).alias(name)
        for i, name in enumerate(names)])
