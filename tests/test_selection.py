"""Exact percentiles by narrowing brackets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from equiwatch.operators import labels as L
from equiwatch.operators import selection as S


def brute(values, p):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    at = (len(v) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi or v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def columns(n=3000):
    rng = random.Random(9)
    inf = math.inf
    return {
        "spread": [rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
        "few": [float(rng.randrange(3)) for _ in range(n)],
        "hot": [0.5 if rng.random() < 0.6 else rng.random() for _ in range(n)],
        "ends": [rng.choice([inf, -inf, None, math.nan, rng.random()]) for _ in range(n)],
        "nans": [math.nan if rng.random() < 0.9 else rng.random() for _ in range(n)],
        "one": [7.0 if i == 5 else None for i in range(n)],
        "none": [None] * n,
    }


SHARES = (0.0, 0.05, 0.35, 0.5, 0.55, 0.8, 0.95, 1.0)


@pytest.mark.parametrize("held", [8, 1024])
def test_matches_a_sort(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data))
    specs = {f"{c}_{i}": (F.col(c), p) for c in data for i, p in enumerate(SHARES)}
    got = S.quantiles(df, specs)
    for c, values in data.items():
        for i, p in enumerate(SHARES):
            assert same(got[f"{c}_{i}"], brute(values, p)), (c, p, got[f"{c}_{i}"], brute(values, p))


def test_counts_decide_where_the_sketch_errs(spark, monkeypatch):
    values = [float(i * 37 % 5003) for i in range(5003)]
    monkeypatch.setattr(S, "HELD", 4)
    right, calls = S._sketch, []

    def wrong(x):
        calls.append(x)
        moved = F.transform(right(x), lambda v: v + F.lit(400.0 if len(calls) % 2 else -700.0))
        return F.when(F.lit(len(calls) < 4), moved).otherwise(right(x))

    monkeypatch.setattr(S, "_sketch", wrong)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    for p in (0.01, 0.5, 0.99):
        calls.clear()
        assert S.quantiles(df, {"m": (F.col("x"), p)})["m"] == brute(values, p)
        assert len(calls) >= 3


def test_passes_only_count_and_sketch(spark, monkeypatch):
    plans = []
    real = S.order_statistics

    def watched(df, *rest):
        kind = type(df)
        agg = kind.agg

        def noted(self, *aggs):
            out = agg(self, *aggs)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(kind, "agg", noted)
        try:
            return real(df, *rest)
        finally:
            monkeypatch.setattr(kind, "agg", agg)

    monkeypatch.setattr(S, "order_statistics", watched)
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    assert S.quantiles(df, {"a": (F.col("x"), 0.25), "b": (F.col("y"), 0.5)}) == {"a": 4999.75, "b": 3.0}
    assert 2 <= len(plans) <= 3
    for plan in plans:
        assert "Generate" not in plan and "Window" not in plan and "rangepartitioning" not in plan and "percentile(" not in plan


def test_methods_and_bad_shares(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    for method in ("exact", "distributed", "buffered"):
        assert L.percentiles(df, {"m": (F.col("x"), 0.75)}, method).first()["m"] == 3.0
    with pytest.raises(ValueError):
        L.percentiles(df, {"m": (F.col("x"), 0.75)}, "other")
    with pytest.raises(ValueError):
        S.quantiles(df, {"m": (F.col("x"), 1.5)})
    assert L.percentiles(df.limit(0), {"m": (F.col("x"), 0.5)}).first()["m"] is None
