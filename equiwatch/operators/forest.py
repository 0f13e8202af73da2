"""Random forests grown whole by one task a tree, from all training rows counted by cell.

A row meets the search for splits only through its bins (``cells.training_grid``), so the
training rows are counted once by cell and class, and a tree is grown from these counts.
Nothing is sampled but each tree's own bootstrap: a row is drawn a Poisson(1) number of
times, hence the rows of a cell and class a Poisson(their count) number of times.

The number of cells is bounded by the bins, whatever the number of rows; their table (a byte
a feature and two counts) is broadcast.  Trees are grown level by level, all nodes of a level
at once, to pure leaves or ``max_depth``.  The nodes are a table and stay one: neither
training nor scoring collects them, and a tree as a whole is one task's at most.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .cells import Grid, cell, codes_of

#: Nodes of a shard of trees and cells of a block when a forest scores.
SHARD_NODES, BLOCK_ROWS = 1 << 20, 1 << 17
#: Least part of the impurity that a split must remove (rounding makes less).
LEAST_GAIN = 1e-12

_NODES = ("tree int, node int, left int, right int, feature int, bin int, threshold double, "
          "value double, cover double, gain double")


class _Level:
    """Splits of one level's open nodes: rows ``ids`` with counts ``k0`` and ``k1`` are in nodes ``at``."""

    def __init__(self, flat, width, bins, ids, k0, k1, at, c0, c1, weights, min_rows):
        self.flat, self.width, self.bins, self.ids, self.k0, self.k1, self.at = flat, width, bins, ids, k0, k1, at
        self.c0, self.c1, self.weights, self.min_rows = c0, c1, weights, min_rows
        self.gain, self.feature, self.bin = np.zeros(len(c0)), np.full(len(c0), -1), np.zeros(len(c0), np.int64)

    def try_features(self, own: np.ndarray) -> None:
        """``own``: a feature for each node."""
        key = self.at * self.bins + self.flat[self.ids * self.width + own[self.at]]
        n = len(self.c0)
        if n * self.bins <= 2 * len(key):  # all bins of all nodes
            left = [np.bincount(key, k, n * self.bins).reshape(n, self.bins).cumsum(axis=1).ravel() for k in (self.k0, self.k1)]
            node, starts = np.repeat(np.arange(n), self.bins), np.arange(n) * self.bins
            at_bin = np.tile(np.arange(self.bins), n)
        else:  # the bins that occur
            packed = np.sort(key << 32 | np.arange(len(key)))
            rows, key = packed & 0xFFFFFFFF, packed >> 32
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            node, at_bin = np.divmod(key[ends], self.bins)
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            left = []
            for k, c in ((self.k0, self.c0), (self.k1, self.c1)):
                before = np.cumsum(c) - c
                left.append(np.cumsum(k[rows])[ends] - before[node])
        self._keep_best(left, node, at_bin, starts, own)

    def _keep_best(self, left, node, at_bin, starts, own) -> None:
        (l0, l1), (w0, w1) = left, self.weights
        r0, r1 = self.c0[node] - l0, self.c1[node] - l1
        fits = (l0 + l1 >= self.min_rows) & (r0 + r1 >= self.min_rows)
        l0, l1, r0, r1 = l0 * w0, l1 * w1, r0 * w0, r1 * w1
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(fits, (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1), -np.inf)
        top = np.maximum.reduceat(score, starts)
        place = np.where(score == top[node], np.arange(len(score)), len(score))
        first = np.minimum.reduceat(place, starts)
        t0, t1 = self.c0 * w0, self.c1 * w1
        gain = (top - (t0 * t0 + t1 * t1) / (t0 + t1)) / (t0 + t1)
        better = gain > np.maximum(self.gain, LEAST_GAIN)
        self.gain[better], self.feature[better], self.bin[better] = gain[better], own[better], at_bin[first[better]]


def grow(codes: np.ndarray, counts: np.ndarray, weights: tuple[float, float], bins: int, rng: np.random.Generator,
         max_depth: int, min_rows: int, tried: int) -> dict[str, np.ndarray]:
    """One tree of cells ``codes`` with ``counts`` (cells x 2 classes), its nodes in preorder."""
    width = codes.shape[1]
    ids = np.flatnonzero(counts.sum(axis=1))
    k0, k1 = counts[ids, 0].astype(float), counts[ids, 1].astype(float)
    flat, at, n, levels = codes.ravel(), np.zeros(len(ids), np.int64), 1, []
    for depth in range(max_depth + 1):
        c0, c1 = np.bincount(at, k0, n), np.bincount(at, k1, n)
        level = {"c0": c0, "c1": c1, "feature": np.full(n, -1), "bin": np.full(n, -1), "gain": np.zeros(n)}
        levels.append(level)
        nodes = np.flatnonzero((c0 > 0) & (c1 > 0) & (c0 + c1 >= 2 * min_rows))
        if depth == max_depth or not len(nodes):
            break
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        rows = place[at] >= 0
        ids, k0, k1, at = ids[rows], k0[rows], k1[rows], place[at[rows]]
        now = _Level(flat, width, bins, ids, k0, k1, at, c0[nodes], c1[nodes], weights, min_rows)
        draws = rng.random((len(nodes), width), np.float32)
        for own in (np.argpartition(draws, tried - 1, axis=1)[:, :tried] if tried < width else
                    np.tile(np.arange(width), (len(nodes), 1))).T:
            now.try_features(own)
        level["feature"][nodes], level["bin"][nodes], level["gain"][nodes] = now.feature, now.bin, now.gain
        split = now.feature >= 0
        rows = split[at]
        ids, k0, k1, at = ids[rows], k0[rows], k1[rows], at[rows]
        goes_left = flat[ids * width + now.feature[at]] <= now.bin[at]
        at, n = 2 * (np.cumsum(split) - 1)[at] + ~goes_left, 2 * int(split.sum())
        if not n:
            break
    return _preorder(levels, weights)


def _preorder(levels: list[dict], weights: tuple[float, float]) -> dict[str, np.ndarray]:
    """A tree's levels as one table whose nodes come before their subtrees, the left one first."""
    sizes = [np.ones(len(x["c0"]), np.int64) for x in levels]
    for above, own, below in zip(levels[-2::-1], sizes[-2::-1], sizes[:0:-1], strict=True):
        own[above["feature"] >= 0] += below[::2] + below[1::2]
    out = {c: np.full(sizes[0][0], -1, np.int32) for c in ("left", "right", "feature", "bin")}
    out |= {c: np.zeros(sizes[0][0]) for c in ("value", "cover", "gain")}
    at = np.zeros(1, np.int64)
    for k, x in enumerate(levels):
        split = x["feature"] >= 0
        t0, t1 = x["c0"] * weights[0], x["c1"] * weights[1]
        for c, v in (("feature", x["feature"]), ("bin", x["bin"]), ("gain", x["gain"]), ("cover", t0 + t1),
                     ("value", np.divide(t1, t0 + t1, out=np.zeros(len(t0)), where=t0 + t1 > 0))):
            out[c][at] = v
        if split.any():
            left = at[split] + 1
            right = left + sizes[k + 1][::2]
            out["left"][at[split]], out["right"][at[split]] = left, right
            at = np.column_stack((left, right)).ravel()
    return out


@dataclass
class ForestModel:
    """A forest whose nodes are a table at ``path`` (as in ``explain.tree_nodes``, with bin and gain)."""

    path: str
    numFeatures: int
    n_trees: int
    grid: Grid

    def nodes(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(_NODES).parquet(self.path)

    def getNumTrees(self) -> int:  # noqa: N802 (MLlib's name)
        return self.n_trees

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Impurity removed by a feature's splits: parts of one in each tree, and their mean in parts of one."""
        own = self.nodes().where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
        whole = own.groupBy("tree").agg(F.sum("g").alias("t"))
        rows = own.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t"))).collect()  # a row a feature
        total = sum(r[1] for r in rows) or 1.0
        out = np.zeros(self.numFeatures)
        for f, g in rows:
            out[f] = g / total
        return DenseVector(out)

    def score_cells(self, cells: DataFrame, name: str, out: str) -> DataFrame:
        """Distinct cells of a column with P(class = 1): the mean of their leaves."""
        nodes, grid, n_trees = self.nodes(), self.grid, self.n_trees
        shards = max(1, min(n_trees, max(16, ceil(nodes.count() / SHARD_NODES))))
        blocks = max(1, ceil(cells.count() / BLOCK_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cut = cells.select(F.col(name).alias("_cell"), F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("_block"))
        cut = cut.withColumn("_shard", every(shards))
        trees = nodes.select("tree", "node", "left", "right", "feature", "bin", "value",
                             F.pmod("tree", F.lit(shards)).alias("_shard")).withColumn("_block", every(blocks))
        pairs = [t.repartition(min(3 * blocks * shards, 100_000), "_block", "_shard").groupBy("_block", "_shard") for t in (cut, trees)]

        def run(own: pa.Table, shard: pa.Table) -> pa.Table:
            own = own.combine_chunks()
            if not len(own):
                return pa.table([own["_cell"], pa.array([], pa.int32()), pa.array([], pa.float64())], names=["_cell", "_s", "_p"])
            total = leaf_sums(codes_of(own["_cell"].combine_chunks(), grid), grid.features, shard)
            s = pa.array(np.full(len(own), shard["_shard"][0].as_py() if len(shard) else 0, np.int32))
            return pa.table([own["_cell"], s, pa.array(total)], names=["_cell", "_s", "_p"])

        parts = pairs[0].cogroup(pairs[1]).applyInArrow(run, "_cell binary, _s int, _p double")
        each = F.array_sort(F.collect_list(F.struct("_s", "_p")))  # added up in one order, so that equal cells score equal
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["_p"])
        return parts.groupBy("_cell").agg((total / F.lit(float(n_trees))).alias(out)).withColumnRenamed("_cell", name)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Rows with ``probability`` and ``prediction``, as MLlib's models have them."""
        rows = df.withColumn("_cell", cell(features, self.grid))
        scored = self.score_cells(rows.select("_cell").distinct(), "_cell", "_p")
        p = F.col("_p")
        return (rows.join(scored, "_cell").withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("_cell", "_p"))

    def save(self, path: str) -> None:
        self.nodes().write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        meta = {"numFeatures": self.numFeatures, "n_trees": self.n_trees, "features": self.grid.features,
                "points": [p.tolist() for p in self.grid.points], "kinds": self.grid.kinds}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "grid"))

    @staticmethod
    def load(path: str) -> ForestModel:
        meta = json.loads(SparkSession.getActiveSession().read.text(os.path.join(path, "grid")).first()[0])
        grid = Grid(meta["numFeatures"], meta["features"], [np.array(p) for p in meta["points"]], meta["kinds"])
        return ForestModel(os.path.join(path, "nodes"), meta["numFeatures"], meta["n_trees"], grid)


def leaf_sums(codes: np.ndarray, features: list[int], shard: pa.Table) -> np.ndarray:
    """Each cell's leaf values added up over the trees of a table of nodes, in the order of their numbers."""
    total = np.zeros(len(codes))
    if not len(shard):
        return total
    shard = shard.sort_by([("tree", "ascending"), ("node", "ascending")])
    place = np.full(max(features, default=0) + 2, 0)
    place[features] = np.arange(len(features))  # columns of the codes
    cols = {c: shard[c].to_numpy() for c in ("tree", "left", "right", "feature", "bin", "value")}
    flat, width = codes.ravel(), codes.shape[1]
    cuts = [0, *(np.flatnonzero(np.diff(cols["tree"])) + 1).tolist(), len(shard)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        left, right, bins, value = (cols[c][lo:hi] for c in ("left", "right", "bin", "value"))
        own = place[cols["feature"][lo:hi]]
        at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
        while True:
            rows = rows[left[at[rows]] >= 0]
            if not len(rows):
                break
            node = at[rows]
            at[rows] = np.where(flat[rows * width + own[node]] <= bins[node], left[node], right[node])
        total += value[at]
    return total


def train_forest(cells: DataFrame, grid: Grid, counts: tuple[str, str], num_trees: int = 300, max_depth: int = 30,
                 min_instances_per_node: int = 2, seed: int = 42, balanced: bool = True) -> ForestModel:
    """A forest of the training rows counted by cell (``cells``: _cell and the two count columns)."""
    spark = cells.sparkSession
    table = cells.where(F.col(counts[0]) + F.col(counts[1]) > 0).orderBy("_cell").select("_cell", *counts).toArrow().combine_chunks()
    codes = codes_of(table["_cell"].combine_chunks(), grid)
    n = np.column_stack([table[c].to_numpy() for c in counts])
    by_class = n.sum(axis=0)
    present = max(1, int((by_class > 0).sum()))
    weights = tuple(float(n.sum() / (present * c)) if balanced and c else 1.0 for c in by_class)
    bins = max([1, *(len(p) for p in grid.points)]) + 1
    width = codes.shape[1]
    tried = max(1, ceil(np.sqrt(grid.n_features)))
    shared = spark.sparkContext.broadcast((codes, n))
    points, features = grid.points, np.array([*grid.features, -1])

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                own, rows = shared.value
                rng = np.random.default_rng([seed, t])
                tree = grow(own, rng.poisson(rows), weights, bins, rng, max_depth, min_instances_per_node, min(tried, width))
                f, m = tree["feature"], len(tree["feature"])
                threshold = np.zeros(m)
                for k, p in enumerate(points):
                    threshold[f == k] = p[tree["bin"][f == k]]
                inner = f >= 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, t, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(tree["left"]), pa.array(tree["right"]),
                    pa.array(features[f].astype(np.int32)), pa.array(tree["bin"]), pa.array(threshold, mask=~inner),
                    pa.array(tree["value"]), pa.array(tree["cover"]), pa.array(tree["gain"])], names=[c.split()[0] for c in _NODES.split(", ")])

    path = scratch_path(spark, "forest")
    spark.range(0, num_trees, 1, num_trees).mapInArrow(run, _NODES).write.parquet(path)
    shared.destroy()
    return ForestModel(path, grid.n_features, num_trees, grid)
