"""Seeded sampling, splitting and batching — reproducible on any partitioning.

Every draw is ``hash_draw(key, seed)``: a function of the row key, so a task
retry, a different partition count or another engine gives the same rows.
Exact-count variants find the draw of the last row that is in (an order statistic,
``selection``) and compare each row's draw with it: no row is ranked, sorted or
moved, but for those that share that very draw.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_draw
from .ordering import global_rank
from .selection import order_statistics


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_draw(df: DataFrame, key: str | Column, seed: int, out: str = "draw") -> DataFrame:
    return df.withColumn(out, hash_draw(key, seed))


def smallest_draws(df: DataFrame, draw: str, tie_order: Sequence[str | Column], quota, cls: str | None = None,
                   classes: Sequence = (None,), out: str = "_in") -> DataFrame:
    """Mark the rows of the ``quota`` smallest draws of each class, exactly that many.

    ``classes`` lists the values of ``cls`` (few; one for all rows without it), ``quota``
    maps their row counts to their quotas.  Rows that share the last draw that is in
    are taken in ``tie_order``.
    """
    own = [F.lit(True) if cls is None else F.col(cls).eqNullSafe(F.lit(c)) for c in classes]
    draws = [F.when(mine, F.col(draw)) for mine in own]
    quotas: list[int] = []

    def last(counts):
        quotas[:] = [min(q, n) for q, n in zip(quota(counts), counts, strict=True)]
        return [(i, q - 1) for i, q in enumerate(quotas) if q > 0]

    _, found = order_statistics(df, draws, last)
    cut = [found.get((i, q - 1)) for i, q in enumerate(quotas)]
    at = [F.lit(False) if c is None else F.coalesce(d == F.lit(c), F.lit(False)) for d, c in zip(draws, cut, strict=True)]
    below = [F.lit(False) if c is None else F.coalesce(d < F.lit(c), F.lit(False)) for d, c in zip(draws, cut, strict=True)]
    counted = df.agg(*[x for i in range(len(cut)) for x in (F.count_if(below[i]), F.count_if(at[i]))]).first() or ()
    room = [q - counted[2 * i] for i, q in enumerate(quotas)]  # of the rows at the cut
    split = [i for i, left in enumerate(room) if 0 < left < counted[2 * i + 1]]
    any_of = lambda parts: F.exists(F.array(*parts), lambda x: x) if parts else F.lit(False)
    inside = any_of([below[i] | at[i] if i not in split else below[i] for i in range(len(cut))])
    if not split:
        return df.withColumn(out, inside)
    shared = any_of([at[i] for i in split])
    place = F.coalesce(*[F.when(own[i], F.lit(i)) for i in split])
    left = F.coalesce(*[F.when(own[i], F.lit(room[i])) for i in split])
    tied = global_rank(df.where(shared).withColumn("_ew_class", place), list(tie_order), out="_ew_place", groups=["_ew_class"])
    tied = tied.withColumn(out, F.col("_ew_place") <= left).drop("_ew_class", "_ew_place")
    return df.where(~shared).withColumn(out, inside).unionByName(tied)


def sample_fraction(df: DataFrame, key: str | Column, fraction: float = 0.35, seed: int = 7,
                    exact: bool = False, key_order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows drawn without replacement.  Default: each row kept when its draw is
    below ``fraction`` (no shuffle at all).  ``exact=True``: exactly
    ``round(fraction·n)`` rows (half to even), the ones with the smallest draws.
    Adds ``draw`` (the row's position in the shuffled order is the draw order)."""
    d = with_draw(df, key, seed)
    if not exact:
        return d.where(F.col("draw") < F.lit(float(fraction)))
    marked = smallest_draws(d, "draw", key_order or [key], lambda counts: [round(n * float(fraction)) for n in counts])
    return marked.where("_in").drop("_in")


def sample_n(df: DataFrame, key: str | Column, n: int = 200, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows with the smallest draws (a top-k: bounded per task)."""
    return with_draw(df, key, seed).orderBy("draw", _col(key)).limit(n)


def split_hash(df: DataFrame, key: str | Column, test_size: float = 0.2, seed: int = 42,
               out: str = "split") -> DataFrame:
    """``test`` when the draw is below ``test_size``, else ``train`` (no shuffle)."""
    return df.withColumn(out, F.when(hash_draw(key, seed) < F.lit(float(test_size)), F.lit("test"))
                         .otherwise(F.lit("train")))


def stratified_split(df: DataFrame, key: str | Column, label: str, test_size: float = 0.2,
                     seed: int = 42, out: str = "split", key_order: Sequence[str | Column] = ()) -> DataFrame:
    """Exact stratified split: ``ceil(test_size·n)`` test rows shared among classes
    by largest remainder (ties to the smaller class value), taking the smallest
    draws inside each class.  One class only → unstratified (the same rule with a
    single group)."""
    d = with_draw(df, key, seed, "_draw").withColumn("_cls", F.coalesce(F.col(label).cast("long"), F.lit(0)))
    classes = sorted(r[0] for r in d.select("_cls").distinct().collect())  # values of a label

    def quotas(counts: list[int]) -> list[int]:
        total = sum(counts)
        test = math.ceil(total * float(test_size))
        if len(counts) == 1:
            return [test]
        shares = [n * test / total for n in counts]
        base = [math.floor(x) for x in shares]
        order = sorted(range(len(counts)), key=lambda i: (base[i] - shares[i], classes[i]))
        for i in order[:test - sum(base)]:
            base[i] += 1
        return base

    if not classes:
        return df.withColumn(out, F.lit("train"))
    marked = smallest_draws(d, "_draw", key_order or [key], quotas, "_cls", classes)
    return marked.withColumn(out, F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))).drop("_draw", "_cls", "_in")


def align_labels(split: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach another label to the split rows by row key (index alignment)."""
    return split.join(labels, key, "inner")


def class_guard(df: DataFrame, labels: Sequence[str], split_col: str = "split") -> DataFrame:
    """Per split and label: positives, negatives, and whether both classes exist."""
    long = df.select(split_col, F.explode(F.array(*[
        F.struct(F.lit(l).alias("target"), F.col(l).cast("int").alias("y")) for l in labels])).alias("_t"))
    g = (long.groupBy(split_col, F.col("_t.target").alias("target"))
         .agg(F.count_if(F.col("_t.y") == 1).alias("n_pos"), F.count_if(F.col("_t.y") == 0).alias("n_neg")))
    return g.withColumn("both_classes", (F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def require_both_classes(guard: DataFrame, split_value: str = "train", split_col: str = "split") -> None:
    """Raise when a label has a single class in the training part (one tiny collect)."""
    bad = [r["target"] for r in guard.where((F.col(split_col) == split_value) & ~F.col("both_classes"))
           .select("target").collect()]
    if bad:
        raise ValueError(f"only one class in the {split_value} split for: {bad}")


def assign_batches(df: DataFrame, order_by: Sequence[str | Column], batch_size: int = 100,
                   out: str = "batch", before: int = 0) -> DataFrame:
    """Consecutive slices of ``batch_size`` rows in ``order_by`` order, numbered
    from 1 (the last one may be short).  ``order_by`` must be a total order;
    ``before`` rows went before these."""
    if not order_by:
        raise ValueError("assign_batches needs an explicit order (e.g. time, key)")
    ranked = global_rank(df, order_by, out="_pos").withColumn("_pos", F.col("_pos") + F.lit(before))
    return ranked.withColumn(out, (F.floor((F.col("_pos") - 1) / F.lit(batch_size)) + 1).cast("long")) \
                 .withColumnRenamed("_pos", "position")


def feature_projection(df: DataFrame, targets: Sequence[str], drop: Sequence[str]) -> DataFrame:
    """Drop both targets and the drop list (absent names ignored); protected stay."""
    return df.drop(*targets, *drop)


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reindex to the training columns: missing → typed NULL, extra → gone, order fixed."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
