"""Embedding whitening with exact covariances by polarisation.

1. Components become whole numbers, ``floor(scale * c) + shift``.  Each distinct vector
   counts once (the fit list); it is written to the shared folder.
2. One pass adds up every dimension.  A second adds up, for every dimension and
   for the sum of every two, the squares of what is left after centring.  With the
   mean's whole part taken off, values are small whole numbers ``w``, and a square
   of the centred value times the number of rows is ``(n*w - r)**2``, where ``r`` is the
   same for all rows; tasks add up ``w*w`` and ``w`` exactly.  Nothing is rounded.
3. Half of what the variance of a sum exceeds the two variances by is the
   covariance.  The matrix, of dimensions squared, is assembled on the driver for
   ``eigh``; it grows with the vectors' length only.
4. All rows are centred, projected and scaled in a map.  A third pass over the fit
   list measures how far the covariance of what came out is from the identity.

Vectors of another length are another table: they have a fit of their own.

Defined cases: a vector that is null or holds null or non-finite entries takes no
part, nor does an empty one (it has no components); scaled entries beyond 2**61 are
held at that; zero vectors, null ids and repeated rows are kept; a component
whose variance is zero but for rounding (fewer distinct vectors than dimensions, a
constant dimension) has null ``whitened`` and takes no part in the error, which is
null if there is no other; ``explained`` is null if all variance is zero; a deviation
over 38 digits is null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrowtext import tidy

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest whole number of a scaled entry.
EDGE = 1 << 61
#: Sums travel as whole numbers of so many bits each, the last with its sign.
LIMB, LIMBS = 40, 8
TILE = 2048


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, size, x) of the usable rows."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(EDGE))), F.lit(float(-EDGE)))
    return (vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(usable).select("id", F.size("v").alias("size"),
                                  F.transform("v", lambda c: F.floor(held(c)) + shift).alias("x")))


def limbs(value: int) -> list[int]:
    """``value`` as ``LIMBS`` parts that can be added up apart."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def joined(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


def blocks(batch: pa.RecordBatch):
    """(size, first row, rows x size matrix) of runs of one length; columns size, x."""
    size = batch.column(0).to_numpy(zero_copy_only=False)
    x = batch.column(1)
    cuts = np.flatnonzero(np.diff(size)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
        for at in range(lo, hi, TILE):
            end = min(hi, at + TILE)
            yield int(size[at]), at, x.slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(end - at, -1)


def exact(m: np.ndarray, most: int) -> np.ndarray:
    """``m`` such that sums of ``TILE`` squares of values up to ``most`` can't overflow."""
    return m if most * most * TILE < 1 << 62 else m.astype(object)


def largest(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min())))


def added(fit: DataFrame, measure, places) -> dict[int, dict[int, int]]:
    """{size: {place: sum}} of what ``measure`` (size, matrix) gives for ``places`` (size) places, exactly."""
    def run(batches):
        total: dict[int, list[int]] = {}
        for b in batches:
            for size, _, m in blocks(b):
                own = total.setdefault(size, [0] * places(size))
                for k, value in enumerate(measure(size, m)):
                    own[k] += int(value)
        for size, own in total.items():
            for lo in range(0, len(own), 8192):
                part = own[lo:lo + 8192]
                cut = [limbs(v) for v in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(part), pa.int32()), pa.array(range(lo, lo + len(part)), pa.int32()),
                     *(pa.array([c[k] for c in cut], pa.int64()) for k in range(LIMBS))],
                    names=["size", "place", *(f"l{k}" for k in range(LIMBS))])

    schema = "size int, place int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
    rows = fit.select("size", "x").mapInArrow(tidy(run), schema).groupBy("size", "place").agg(
        *[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    out: dict[int, dict[int, int]] = {}
    for r in rows.collect():  # dimensions squared, whatever the number of vectors
        out.setdefault(r["size"], {})[r["place"]] = joined(r[2:])
    return out


@dataclass
class Whitener:
    """The fit for vectors of one length: ``n`` distinct ones, sums ``total``, covariance and its components."""

    n: int
    total: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.total], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.total]

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance isn't zero but for rounding."""
        return self.values > max(self.values[0], 0) * len(self.total) * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(max(e, 0.0)) / trace if trace > 0 else None for e in self.values]

    def whiten(self, m: np.ndarray) -> np.ndarray:
        """Rows x components; not a number where a component isn't usable."""
        centred = (m - self.whole_mean).astype(float) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, m: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n*x - total)**2`` of every row."""
        w = m - self.whole_mean
        if (self.n * (largest(w) + 1)) ** 2 * len(self.total) < 1 << 62:
            c = self.n * w - np.array(self.rest)
            return (c * c).sum(axis=1).tolist()
        out = []
        for lo in range(0, len(w), 256):
            c = w[lo:lo + 256].astype(object) * self.n - np.array(self.rest, object)
            out += (c * c).sum(axis=1).tolist()
        return out


def pair_places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second dimension of every place: each one alone, then every two."""
    a, b = np.triu_indices(size, 1)
    return np.concatenate((np.arange(size), a)), np.concatenate((np.arange(size), b))


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """The fit for every vector length of ``fit`` (size, x; distinct)."""
    first = added(fit, lambda size, m: [len(m), *exact(m, largest(m)).sum(axis=0).tolist()], lambda size: size + 1)
    n = {size: own[0] for size, own in first.items()}
    total = {size: [own[k + 1] for k in range(size)] for size, own in first.items()}
    mean = {size: np.array([s // n[size] for s in total[size]], np.int64) for size in total}

    def squares(size, m):
        w = m - mean[size]
        w = exact(w, 2 * largest(w))
        yield from w.sum(axis=0).tolist()
        yield from (w * w).sum(axis=0).tolist()
        for a in range(size - 1):
            pair = w[:, a + 1:] + w[:, a:a + 1]
            yield from (pair * pair).sum(axis=0).tolist()

    sums = added(fit, squares, lambda size: size + size * (size + 1) // 2)
    out = {}
    for size, own in sums.items():
        rows, rest = n[size], [s % n[size] for s in total[size]]
        line = [own[k] for k in range(size)]
        a, b = pair_places(size)
        spread = {}  # sum of (n*x - total)**2, of a dimension or the sum of two
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            w, r = (line[i], rest[i]) if i == j else (line[i] + line[j], rest[i] + rest[j])
            spread[i, j] = rows * rows * own[size + k] - 2 * rows * r * w + rows * r * r
        covariance = np.empty((size, size))
        for (i, j), s in spread.items():
            value = s / rows ** 3 if i == j else (s - spread[i, i] - spread[j, j]) / (2 * rows ** 3)
            covariance[i, j] = covariance[j, i] = value
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        out[size] = Whitener(rows, total[size], covariance, values, vectors)
    return out


def identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float | None]:
    """Largest entry of the whitened fit list's covariance less the identity, by vector length."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, m in blocks(b):
                y = models[size].whiten(m)
                total[size] = total.get(size, 0.0) + y.T @ y / models[size].n
        for size, c in total.items():
            a, z = np.indices(c.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * c.size, pa.int32()), pa.array(a.ravel().astype(np.int32)),
                 pa.array(z.ravel().astype(np.int32)), pa.array(c.ravel())], names=["size", "a", "b", "c"])

    rows = fit.select("size", "x").mapInArrow(tidy(run), "size int, a int, b int, c double").groupBy("size", "a", "b").agg(
        F.sum("c").alias("c"))
    off = F.abs(F.col("c") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    found = rows.where(~F.isnan("c")).groupBy("size").agg(F.max(off).alias("off")).collect()
    return {size: None for size in models} | {r["size"]: r["off"] for r in found}


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, dict[int, Whitener]]:
    """id, size, n, deviation decimal(38,0) and whitened (array; null entries) of every usable row, and the fits."""
    rows = whole_numbers(vectors, key, vector, scale, shift)
    path = scratch_path(vectors.sparkSession, "whitening-fit")
    rows.select("size", "x").distinct().write.parquet(path)
    fit = vectors.sparkSession.read.schema("size int, x array<bigint>").parquet(path)
    models = fit_whitening(fit, components)
    for size, off in identity_errors(fit, models).items():
        models[size].identity_error = off
    kind = vectors.schema[key].dataType.simpleString()
    wide = Context(prec=80)

    def run(batches):
        for b in batches:
            done, numbers, deviations, out = 0, [], [], []
            for size, at, m in blocks(pa.RecordBatch.from_arrays([b.column(1), b.column(2)], names=["size", "x"])):
                model = models[size]
                numbers += [model.n] * len(m)
                deviations += [Decimal(v) if v < 10 ** 38 else None for v in model.deviations(m)]
                out += [[None if x != x else x for x in y] for y in model.whiten(m).tolist()]
                done = at + len(m)
            assert done == len(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(numbers, pa.int64()),
                 pa.array([v if v is None else wide.create_decimal(v) for v in deviations], pa.decimal128(38, 0)),
                 pa.array(out, pa.list_(pa.float64()))], names=["id", "size", "n", "deviation", "whitened"])

    return rows.mapInArrow(tidy(run), f"id {kind}, size int, n bigint, deviation decimal(38,0), whitened array<double>"), models


def component_rows(whitened: DataFrame, models: dict[int, Whitener]) -> DataFrame:
    """One row per vector and component, with the fit's figures beside it."""
    spark = whitened.sparkSession
    facts = [(size, m.identity_error, m.explained) for size, m in sorted(models.items())]
    table = spark.createDataFrame(facts, "size int, identity_error double, share array<double>")
    return (whitened.join(F.broadcast(table), "size")  # a row per vector length
            .select("id", "n", "deviation", "identity_error", "share", F.posexplode("whitened").alias("k", "whitened"))
            .select("id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get("share", F.col("k")).alias("explained"), "identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    rows, models = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return component_rows(rows, models).select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        "explained", "identity_error")
