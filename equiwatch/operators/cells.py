"""Cells of a tree ensemble: feature vectors that no split of any of its trees tells apart.

A row meets a model only through its splits, so its cell (per feature that is split on,
the place among the model's split points, or the category) decides every leaf it
reaches.  Scores and attributions are worked out once for every cell that occurs and
joined to the rows by the cell.  Split points are few per feature (MLlib has ``maxBins``
at most), so the number of cells is bounded by the model, whatever the number of rows;
with many features it nears the number of rows, and the cost is one shuffle of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import order_statistics


@dataclass
class Grid:
    """Sorted split points of each feature that is split on; ``kinds``: whether they are categories."""

    n_features: int
    features: list[int]
    points: list[np.ndarray]
    kinds: list[bool]

    def dtype(self) -> str:
        most = max((len(p) for p in self.points), default=0)
        return "u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, features split on) of the rows of ``x``; equal codes reach equal leaves."""
        out = np.zeros((len(x), max(1, len(self.features))), self.dtype())
        for k, (f, points, kind) in enumerate(zip(self.features, self.points, self.kinds, strict=True)):
            at = np.searchsorted(points, x[:, f])  # NaN comes last: beyond every point
            if kind:  # beside every category: one place for all that
                at = np.where(points[np.minimum(at, len(points) - 1)] == x[:, f], at, len(points))
            out[:, k] = at
        return out

    def values(self, codes: np.ndarray) -> np.ndarray:
        """A row of each cell: the greatest value there is up to the next point, or the category itself."""
        x = np.zeros((len(codes), self.n_features))
        for k, (f, points) in enumerate(zip(self.features, self.points, strict=True)):
            x[:, f] = np.append(points, points[-1] + max(1.0, abs(points[-1])))[codes[:, k]]
        return x


def grid_of(nodes: DataFrame, n_features: int) -> Grid:
    """The grid of a table of nodes (``explain.tree_nodes``); its points are the model's own, once each."""
    splits = nodes.where("left >= 0").select("feature", "threshold", F.when(F.col("threshold").isNull(), F.col("arity")).alias("arity"),
                                             "categories").distinct().collect()
    points: dict[int, set] = {}
    kinds = {r["feature"] for r in splits if r["threshold"] is None}
    for r in splits:
        own = points.setdefault(r["feature"], set())
        own.update([r["threshold"]] if r["threshold"] is not None else [*map(float, range(r["arity"])), *r["categories"]])
    features = sorted(points)
    return Grid(n_features, features, [np.array(sorted(points[f])) for f in features], [f in kinds for f in features])


def _to_binary(codes: np.ndarray) -> pa.Array:
    n, width = len(codes), codes.shape[1] * codes.itemsize
    if n * width >= 1 << 31:
        raise ValueError("a batch of cells is over 2 GB")
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])


def _lists(x: np.ndarray) -> pa.Array:
    n, f = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(f)), pa.array(np.ascontiguousarray(x).ravel()))


def codes_of(cells: pa.Array, grid: Grid) -> np.ndarray:
    """The codes of each cell."""
    if not len(cells):
        return np.zeros((0, max(1, len(grid.features))), grid.dtype())
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]  # all of one width
    flat = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(grid.dtype())
    return flat.reshape(len(cells), max(1, len(grid.features)))


def values_of(cells: pa.Array, grid: Grid) -> np.ndarray:
    """A row of features for each cell."""
    return grid.values(codes_of(cells, grid))


def cell(features: str, grid: Grid) -> Column:
    """The cell of a vector column."""
    n = grid.n_features

    @F.arrow_udf("binary")
    def code(x: pa.Array) -> pa.Array:
        return _to_binary(grid.codes(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), n)))

    return code(vector_to_array(F.col(f"`{features}`")))


def cell_values(name: str, grid: Grid) -> Column:
    """The feature values (array) of a row of each cell of a column."""
    @F.arrow_udf("array<double>")
    def values(cells: pa.Array) -> pa.Array:
        return _lists(values_of(cells, grid))

    return values(F.col(f"`{name}`"))


def cell_codes(name: str, grid: Grid) -> Column:
    """The codes (array) of a column of cells."""
    @F.arrow_udf("array<double>")
    def codes(cells: pa.Array) -> pa.Array:
        return _lists(codes_of(cells, grid).astype(float))

    return codes(F.col(f"`{name}`"))


def training_grid(df: DataFrame, features: str, n_features: int, max_bins: int = 32) -> Grid:
    """The split points that training may use, from all rows: at most ``max_bins`` bins a feature.

    Midway between neighbours where a feature has that many values at most, else the values at
    ``max_bins`` equal parts of the rows (exact order statistics).
    """
    x = vector_to_array(F.col(f"`{features}`"))

    def values(batches):
        seen = [set() for _ in range(n_features)]
        for b in batches:
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), n_features)
            for f, own in enumerate(seen):
                if len(own) <= max_bins:
                    own.update(np.unique(rows[:, f]).tolist()[:max_bins + 1])
        pairs = [(f, v) for f, own in enumerate(seen) for v in (own if len(own) <= max_bins else [None])]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.float64())],
                                         names=["f", "v"])

    found: dict[int, list] = {f: [] for f in range(n_features)}
    for r in df.select(x.alias("x")).mapInArrow(values, "f int, v double").distinct().collect():  # a task gives ``max_bins`` a feature at most
        found[r["f"]].append(r["v"])
    many = [f for f, v in found.items() if None in v or len(v) > max_bins]
    points = {f: (np.array(sorted(v)[1:]) + np.array(sorted(v)[:-1])) / 2 for f, v in found.items() if f not in many}
    if many:
        ranks = lambda counts: [(k, -(-i * n // max_bins) - 1) for k, n in enumerate(counts) for i in range(1, max_bins) if n]
        _, got = order_statistics(df.select(x.alias("x")), [F.get("x", F.lit(f)) for f in many], ranks)
        for k, f in enumerate(many):
            points[f] = np.array(sorted({v for (c, _), v in got.items() if c == k and not np.isnan(v)}))
    used = [f for f in range(n_features) if len(points[f])]
    return Grid(n_features, used, [points[f] for f in used], [False] * len(used))
