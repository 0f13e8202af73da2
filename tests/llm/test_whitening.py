"""Embedding whitening against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from equiwatch.llm import whitening as W
from equiwatch.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, size int, n long, x string, id long"


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, components=16):
    """{length: (n, S, deviations by x, whitening function, shares)} with exact sums of products."""
    out = {}
    whole = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in usable(rows)]
    for size in {len(x) for x in whole}:
        fit = sorted({x for x in whole if len(x) == size})
        n = len(fit)
        total = [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[n * c - s for c, s in zip(x, total, strict=True)] for x in fit], object)
        product = centred.T @ centred
        cov = np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in product])
        out[size] = n, total, cov
    return out


def check(rows, whitened, models):
    want = brute(rows)
    assert set(models) == set(want)
    got = whitened.collect()
    assert sorted(repr(r["id"]) for r in got) == sorted(repr(i) for i, _ in usable(rows))
    vectors = {}
    for i, v in usable(rows):
        vectors.setdefault(i, []).append(tuple(math.floor(64 * c) + 1_000_000 for c in v))
    for size, (n, total, cov) in want.items():
        m = models[size]
        assert (m.n, m.total) == (n, total)
        np.testing.assert_allclose(m.covariance, cov, rtol=1e-12, atol=0)
        values, axes = np.linalg.eigh(cov)
        k = len(m.values)
        assert k == min(16, size)
        np.testing.assert_allclose(m.values, values[::-1][:k], rtol=1e-6, atol=1e-9 * max(values[-1], 1e-300))
        if m.identity_error is not None:
            assert m.identity_error < 1e-4
    for r in got:
        x = next(x for x in vectors[r["id"]] if len(x) == r["size"])
        n, total, _ = want[r["size"]]
        exact = {sum((n * c - s) ** 2 for c, s in zip(y, total, strict=True)) for y in vectors[r["id"]] if len(y) == r["size"]}
        assert r["n"] == n
        assert (None if r["deviation"] is None else int(r["deviation"])) in {d if d < 10 ** 38 else None for d in exact}
        m = models[r["size"]]
        if len(exact) == 1:
            centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, total, strict=True)])
            for k, y in enumerate(r["whitened"]):
                assert (y is None) == (not m.usable[k])
                if y is not None:
                    z = centred @ m.vectors[:, k] / math.sqrt(m.values[k])
                    assert math.isclose(y, z, rel_tol=1e-8, abs_tol=1e-9)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_table(spark, sf):
    path = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in df.collect()]
    whitened, models = W.whiten(df)
    check(rows, whitened, models)
    got = QUERIES["op13_whitening"](spark, path).collect()
    assert len(got) == 16 * len(usable(rows))
    assert {r["component"] for r in got} == set(range(1, 17))
    m = models[len(rows[0][1])]
    for r in got:
        assert abs(r["explained"] / m.explained[r["component"] - 1] - 1) < 1e-9
        assert r["identity_error"] < 1e-6 and r["n"] == m.n
    # the whitened values themselves: uncorrelated with variance 1 over the distinct vectors
    fit = {tuple(math.floor(64 * c) for c in v): i for i, v in usable(rows)}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    y = np.array([[by[i][k] for k in range(1, 17)] for i in fit.values()])
    np.testing.assert_allclose(y.T @ y / len(y), np.eye(16), atol=1e-6)


def odd_rows():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 1), 0.25]) for i in range(9)]  # a length of its own, one dimension constant
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [math.nan] * 5), (204, [math.inf] * 5)]
    rows += [(205, [0.0] * 5), (None, [0.5] * 5), (None, None), (3, rows[3][1]), (3, rows[4][1]), (300, [7.0])]
    return rows


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)
    whitened, models = W.whiten(df)
    check(rows, whitened, models)
    assert models[2].usable.tolist() == [True, False]
    one = models[1]  # a single vector: no variance at all
    assert one.usable.tolist() == [False] and one.explained == [None] and one.identity_error is None
    flat = W.component_rows(whitened, models).collect()
    assert len(flat) == sum(min(16, len(v)) for _, v in usable(rows))


def test_large_values_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 9, 14]) for _ in range(3)]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)
    check(rows, *W.whiten(df))
    df = spark.createDataFrame([(1, [1e300, 0.0], 1, 2, "", 3), (2, [-1e300, 1.0], 1, 2, "", 3)], SCHEMA)
    whitened, models = W.whiten(df)
    assert models[2].total[0] == 2_000_000  # held at the edges
    assert len(whitened.collect()) == 2


def test_many_copies_count_once(spark):
    rows = [(i, [0.5, 0.25, 1.0]) for i in range(3000)] + [(9000 + i, [i / 64, -i / 64, i * i / 64]) for i in range(20)]
    whitened, models = W.whiten(spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA).repartition(7))
    assert models[3].n == 21
    check(rows, whitened, models)


def test_empty_table(spark):
    whitened, models = W.whiten(spark.createDataFrame([], SCHEMA))
    assert models == {} and whitened.collect() == []
    assert W.component_rows(whitened, models).collect() == []
    whitened, models = W.whiten(spark.createDataFrame([(1, None, 1, 2, "", 3)], SCHEMA))
    assert models == {} and whitened.collect() == []


@pytest.mark.parametrize("value", [0, 1, -1, 1 << 39, -(1 << 40), (1 << 200) + 12345, -(1 << 210) - 7])
def test_parts_of_sums(value):
    parts = W.limbs(value)
    assert W.joined(parts) == value
    assert all(-(1 << 63) <= p < 1 << 63 for p in parts)
    assert W.joined([a + b for a, b in zip(parts, W.limbs(-5), strict=True)]) == value - 5
