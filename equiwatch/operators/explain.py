"""Tree attributions (path-dependent Shapley values) as a distributed scoring job.

Method: Lundberg, Erion & Lee, "Consistent Individualized Feature Attribution
for Tree Ensembles" (2018).  For one root-to-leaf path with distinct features
P, feature j has a *zero fraction* zⱼ (product of the cover ratios of its splits
on the path) and a *one fraction* oⱼ(x) (1 if x satisfies all of its splits).  The
leaf's value function is v(S) = value·∏_{j∈S} oⱼ·∏_{j∉S} zⱼ; with the weights written
as ∫ sᵏ(1−s)^{m−1−k} ds, its exact Shapley value for i ∈ P is

    φᵢ = value · (oᵢ − zᵢ) · ∫₀¹ ∏_{j∈P, j≠i} (zⱼ(1−s) + oⱼ s) ds,

a polynomial in s of degree m − 1, so ⌈m/2⌉ Gauss–Legendre nodes give the integral
without error.  Summing over leaves and trees (times the tree weights) gives the
attribution; the expected value is Σ value·∏ zⱼ.  Attributions plus expected value
equal the model output for every row (margin for boosting, P(class 1) for forests).

Execution: the nodes are a table, read from the saved model; only its distinct split
points are collected.  Rows that no split tells apart (``cells``) have the same
attributions, which are worked out once for every such cell that occurs and joined
to the rows.  Trees are dealt into shards of about ``SHARD_NODES`` nodes and cells into blocks of
about ``BLOCK_ROWS`` (up to four times that where there are more shards, since each walk of a
tree has a cost of its own); a block and a shard are one cogroup, and the shards' parts of a
cell are summed by an aggregate.  A tree as a whole is one task's at least (Spark's
own model holds all of them on the driver).  Within a cogroup a tree is walked once
for all rows.  Rows with the same one fractions on the path so far are one group; a
subtree whose splits leave ``CODES`` groups at most is worked out per group that
occurs, and handed to the rows by one lookup a feature.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .cells import Grid, cell, codes_of, grid_of, values_of
from .ordering import materialize

#: Nodes of a shard of trees, rows of a block, and groups of a subtree that are worked out together.
SHARD_NODES, BLOCK_ROWS, CODES = 1 << 13, 1 << 15, 1 << 11
#: Feature values of a block at most.
BLOCK_VALUES = 1 << 22
#: For ``grid_attributions``: values of all grids at most, cells times nodes at least, nodes of a shard, and cells of a block.
GRID_VALUES, LEAST_WALK, GRID_NODES, GRID_ROWS = 1 << 28, 1 << 32, 1 << 17, 1 << 19


def tree_nodes(model, path: str | None = None) -> DataFrame:
    """One row per node of a saved ensemble (saved to ``path`` or a scratch folder here).

    tree, node, left, right (-1: none), feature, threshold, categories (those that
    go left; null at a threshold) of ``arity`` in all, value, cover, weight.
    """
    from pyspark.sql import SparkSession

    from .forest import ForestModel
    spark = SparkSession.getActiveSession()
    if isinstance(model, ForestModel):  # a table already
        return model.nodes().select("tree", "node", "left", "right", "feature", "threshold", F.lit(None).cast("array<double>").alias("categories"),
                                    F.lit(None).cast("int").alias("arity"), "value", "cover",
                                    F.lit(1.0 / model.getNumTrees()).alias("weight"))
    if path is None:
        path = scratch_path(spark, "tree-model")
        model.write().overwrite().save(path)
    rows = spark.read.parquet(os.path.join(path, "data")).select(F.col("treeID").alias("tree"), "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    if isinstance(model, GBTClassificationModel):
        value, cover = F.col("prediction"), F.get("impurityStats", F.lit(0))
        weight = F.get(F.array(*[F.lit(float(w)) for w in model.treeWeights]), F.col("tree"))
    elif isinstance(model, RandomForestClassificationModel):
        value = F.when(total > 0, F.coalesce(F.get("impurityStats", F.lit(1)), F.lit(0.0)) / total).otherwise(F.lit(0.0))
        cover, weight = total, F.lit(1.0 / model.getNumTrees)
    else:
        raise TypeError("tree attributions need a GBT or random forest classification model")
    grouped = F.col("split.numCategories") >= 0
    return rows.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.when(~grouped, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(grouped, F.col("split.leftCategoriesOrThreshold")).alias("categories"),
        F.when(grouped, F.col("split.numCategories")).alias("arity"),
        value.cast("double").alias("value"), cover.cast("double").alias("cover"), weight.alias("weight"))


def leaf_attribution(one: np.ndarray, zero: np.ndarray, value: float) -> np.ndarray:
    """φ (n, m) for one leaf from one fractions (n, m), 0 or 1, and zero fractions (m,)."""
    m = one.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss(ceil(m / 2))
    out = np.zeros(one.shape)
    for s, w in zip((nodes + 1) / 2, weights / 2, strict=True):
        t = zero * (1 - s) + one * s
        whole = w * t.prod(axis=1, keepdims=True)
        np.add(out, np.divide(whole, t, out=np.zeros_like(t), where=t > 0), out=out)  # t = 0 only where o = z = 0
    return value * (one - zero) * out


class Tree:
    """One tree's nodes as arrays in the order of their numbers (a node comes before its subtree)."""

    def __init__(self, columns: dict[str, np.ndarray], categories: Sequence):
        self.left, self.right, self.feature = columns["left"], columns["right"], columns["feature"]
        self.threshold, self.value, self.cover = columns["threshold"], columns["value"], columns["cover"]
        self.weight, self.categories = float(columns["weight"][0]), categories
        self.splits = np.zeros(len(self.left), np.int64)  # below a node, itself included
        for i in range(len(self.left) - 1, -1, -1):
            if self.left[i] >= 0:
                self.splits[i] = 1 + self.splits[self.left[i]] + self.splits[self.right[i]]

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        own = x[self.feature[node]]
        kinds = self.categories[node]
        return own <= self.threshold[node] if kinds is None else np.isin(own, kinds)

    def children(self, node: int):
        """(child, whether it is the left one, its share of the node's cover)."""
        for child, left in ((int(self.left[node]), True), (int(self.right[node]), False)):
            yield child, left, self.cover[child] / self.cover[node] if self.cover[node] > 0 else 0.0


def trees_of(nodes: pa.Table) -> list[Tree]:
    """The trees of a table of nodes, in the order of their numbers."""
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
    columns = {c: nodes[c].to_numpy() for c in ("tree", "node", "left", "right", "feature", "threshold", "value", "cover", "weight")}
    categories = [None if c is None else np.array(c, float) for c in nodes["categories"].to_pylist()]
    cuts = np.flatnonzero(np.diff(columns["tree"])) + 1
    bounds = zip([0, *cuts.tolist()], [*cuts.tolist(), len(nodes)], strict=True)
    return [Tree({c: v[lo:hi] for c, v in columns.items()}, categories[lo:hi]) for lo, hi in bounds if hi > lo]


class _Sums:
    """Attributions (features x rows), outputs and the expected value, added up over trees."""

    def __init__(self, x: np.ndarray):
        self.x, self.phi, self.output, self.expected = x, np.zeros(x.shape), np.zeros(x.shape[1]), 0.0

    def add(self, tree: Tree) -> None:
        n = self.x.shape[1]
        self._walk(tree, 0, np.zeros(n, np.int32), np.zeros((1, 0), bool), [], [])

    def _walk(self, tree: Tree, node: int, group: np.ndarray, one: np.ndarray, features: list, zero: list) -> None:
        """``group``: each row's group; ``one``: groups x path features; ``zero``: by path feature."""
        splits = int(tree.splits[node])
        if splits < 31 and len(one) << splits <= CODES or not splits:
            self._subtree(tree, node, group, one, features, zero)
            return
        f, left = int(tree.feature[node]), tree.goes_left(node, self.x)
        known = features.index(f) if f in features else None
        for child, is_left, share in tree.children(node):
            follows = left if is_left else ~left
            if known is not None:
                follows = follows & one[:, known][group]
            key = group * 2 + follows
            present = np.zeros(2 * len(one), bool)
            present[key] = True
            found = np.flatnonzero(present)
            place = np.cumsum(present, dtype=np.int32) - 1
            bits, up = (found & 1).astype(bool), one[found >> 1]
            if known is None:
                self._walk(tree, child, place[key], np.column_stack((up, bits)), [*features, f], [*zero, share])
            else:
                up[:, known] = bits
                scaled = [z * share if j == known else z for j, z in enumerate(zero)]
                self._walk(tree, child, place[key], up, features, scaled)

    def _subtree(self, tree: Tree, node: int, group, one, features: list, zero: list) -> None:
        splits = [i for i in range(node, node + 2 * int(tree.splits[node]) + 1) if tree.left[i] >= 0]
        code = group
        for i in splits:
            code = code * 2 + tree.goes_left(i, self.x)
        present = np.zeros(len(one) << len(splits), bool)
        present[code] = True
        found = np.flatnonzero(present)
        code = (np.cumsum(present) - 1)[code]
        goes = {i: ((found >> (len(splits) - 1 - k)) & 1).astype(bool) for k, i in enumerate(splits)}
        base = one[found >> len(splits)]
        table: dict[int, np.ndarray] = {}
        output = np.zeros(len(found))
        todo = [(node, features, zero, list(base.T))]
        while todo:
            at, path, shares, follows = todo.pop()
            if tree.left[at] >= 0:
                f = int(tree.feature[at])
                for child, is_left, share in tree.children(at):
                    bit = goes[at] if is_left else ~goes[at]
                    if f in path:
                        k = path.index(f)
                        todo.append((child, path, [z * share if j == k else z for j, z in enumerate(shares)],
                                     [o & bit if j == k else o for j, o in enumerate(follows)]))
                    else:
                        todo.append((child, [*path, f], [*shares, share], [*follows, bit]))
                continue
            value = float(tree.value[at])
            self.expected += tree.weight * value * float(np.prod(shares))
            if not path:
                output += value
                continue
            pattern = np.stack(follows, axis=1)
            output[pattern.all(axis=1)] += value
            if len(path) < 63:  # equal patterns once
                _, which, back = np.unique(pattern @ (1 << np.arange(len(path))), return_index=True, return_inverse=True)
            else:
                which = back = np.arange(len(pattern))
            phi = leaf_attribution(pattern[which].astype(float), np.array(shares), value)[back]
            for k, f in enumerate(path):
                table[f] = table[f] + phi[:, k] if f in table else phi[:, k]
        self.output += tree.weight * output[code]
        for f, own in table.items():
            self.phi[f] += tree.weight * own[code]


def ensemble_attributions(x: np.ndarray, trees: Sequence[Tree]) -> tuple[np.ndarray, float, np.ndarray]:
    """(φ (n, F), expected value, model output (n,)) of the rows of ``x``."""
    sums = _Sums(np.ascontiguousarray(x.T))
    for tree in trees:
        sums.add(tree)
    return sums.phi.T, sums.expected, sums.output


class _Boxes:
    """The leaves of some trees as boxes of codes, with the zero fraction of every feature on their paths."""

    def __init__(self, trees: Sequence[Tree], grid: Grid):
        column, width = {f: k for k, f in enumerate(grid.features)}, len(grid.features)
        top = np.array([len(p) for p in grid.points])
        found = []
        for tree in trees:
            n = len(tree.left)
            lo, hi, zero, known = np.zeros((n, width), np.int64), np.tile(top, (n, 1)), np.ones((n, width)), np.zeros((n, width), bool)
            for i in np.flatnonzero(tree.left >= 0).tolist():  # a node comes before its subtree
                k = column[int(tree.feature[i])]
                at = int(np.searchsorted(grid.points[k], tree.threshold[i]))
                for child, is_left, share in tree.children(i):
                    lo[child], hi[child], zero[child], known[child] = lo[i], hi[i], zero[i], known[i]
                    zero[child, k] *= share
                    known[child, k] = True
                    if is_left:
                        hi[child, k] = min(hi[child, k], at)
                    else:
                        lo[child, k] = max(lo[child, k], at + 1)
            leaf = tree.left < 0
            found.append((lo[leaf], hi[leaf], zero[leaf], known[leaf], tree.weight * tree.value[leaf].astype(float)))
        self.lo, self.hi, self.zero, self.known, self.value = (np.concatenate(x) for x in zip(*found, strict=True))
        self.top = top


def grid_attributions(codes: np.ndarray, grid: Grid, trees: Sequence[Tree]) -> tuple[np.ndarray, float, np.ndarray]:
    """As ``ensemble_attributions``, for the rows of ``codes``, by the interactions of every set of features.

    With dⱼ = oⱼ − zⱼ a leaf's value function is Σ over T of value·∏_{j∈T} dⱼ·∏_{j∉T} zⱼ, so a set T of features
    adds D(T) = Σ over leaves of that product, shared evenly by its members.  D(T) is a function of
    the codes of T alone.  Along a feature of many codes dⱼ is three steps, so all leaves put their corners into
    one grid a set, and running sums along its axes make D(T); two-valued features have a column for each of their
    combinations that occur.  A leaf costs its corners, whatever the number of rows.
    """
    boxes, n = _Boxes(trees, grid), len(codes)
    wide = [k for k, t in enumerate(boxes.top) if t > 1]
    two = [k for k, t in enumerate(boxes.top) if t == 1]
    phi = np.zeros((grid.n_features, n))
    expected = float((boxes.value * boxes.zero.prod(axis=1)).sum())
    output = np.full(n, expected)
    bits = np.zeros(n, np.int64)
    for b, k in enumerate(two):
        bits |= codes[:, k].astype(np.int64) << b
    kinds, kind = np.unique(bits, return_inverse=True)
    known_bits = (boxes.known[:, two] << np.arange(len(two))).sum(axis=1)
    step = [np.where(((kinds >> b) & 1)[None, :] == 0, boxes.lo[:, k, None] == 0, boxes.hi[:, k, None] == 1) - boxes.zero[:, k, None]
            for b, k in enumerate(two)]  # leaves x kinds
    sets = []  # of two-valued features: members, each kind's column, leaves that know them (-1: not), and their factors
    for h in range(1 << len(two)):
        leaves = np.flatnonzero((known_bits & h) == h)
        if not len(leaves):
            continue
        first: dict = {}
        which = np.array([first.setdefault(v, len(first)) for v in (kinds & h).tolist()])
        pick = [int(np.flatnonzero(which == i)[0]) for i in range(len(first))]
        factor = np.ones((len(pick), len(leaves)))
        for b, k in enumerate(two):
            factor *= step[b][np.ix_(leaves, pick)].T if h >> b & 1 else boxes.zero[leaves, k]
        where = np.full(len(boxes.value), -1, np.int32)
        where[leaves] = np.arange(len(leaves))
        sets.append(([k for b, k in enumerate(two) if h >> b & 1], which, where, factor))
    for a in range(1 << len(wide)):
        own = [k for i, k in enumerate(wide) if a >> i & 1]
        rest = [k for k in wide if k not in own]
        leaf = np.flatnonzero(boxes.known[:, own].all(axis=1)) if own else np.arange(len(boxes.value))
        at, coef = np.zeros(len(leaf), np.int64), boxes.value[leaf] * boxes.zero[leaf][:, rest].prod(axis=1)
        place, shape = np.zeros(n, np.int64), []
        for k in own:
            size = int(boxes.top[k]) + 1
            shape.append(size)
            place = place * size + codes[:, k]
            lo, hi, zero = boxes.lo[leaf, k], boxes.hi[leaf, k], boxes.zero[leaf, k]
            up, down = lo > 0, hi < size - 1
            base = at * size
            at = np.concatenate((base, (base + lo)[up], (base + hi + 1)[down]))
            coef = np.concatenate((coef * (~up - zero), coef[up], -coef[down]))
            leaf = np.concatenate((leaf, leaf[up], leaf[down]))
        cells, back = np.unique(place * len(kinds) + kind, return_inverse=True)
        cell_at, cell_kind = np.divmod(cells, len(kinds))
        size = int(np.prod(shape, dtype=np.int64)) if shape else 1
        sums = {k: np.zeros(len(cells)) for k in [*own, *two]}
        total, shared = np.zeros(len(cells)), np.zeros(len(cells))
        for members, which, where, factor in sets:
            if not own and not members:
                continue
            mine = where[leaf]
            has = np.flatnonzero(mine >= 0)
            if not len(has):
                continue
            mine, own_at, own_coef = mine[has], at[has], coef[has]
            grids = np.empty((len(factor), size))
            for i, f in enumerate(factor):
                grids[i] = np.bincount(own_at, own_coef * f[mine], size)
            grids = grids.reshape(len(factor), *shape)
            for axis in range(1, grids.ndim):
                np.cumsum(grids, axis=axis, out=grids)
            got = grids.ravel()[(which * size)[cell_kind] + cell_at]
            total += got
            got = got / (len(own) + len(members))
            shared += got
            for k in members:
                sums[k] += got
        output += total[back]
        for k in own:
            sums[k] += shared
        for k, v in sums.items():
            phi[grid.features[k]] += v[back]
    return phi.T, expected, output


def _grid_pays(grid: Grid, n_cells: int, n_nodes: int) -> bool:
    """Whether sets of features are worked out by grids: few features, small grids, and many cells times nodes."""
    sizes = [len(p) + 1 for p in grid.points]
    wide = [s for s in sizes if s > 2]
    cost = float(np.prod([s + 1.0 for s in wide])) * 2.0 ** (len(sizes) - len(wide))
    return not any(grid.kinds) and len(sizes) <= 16 and cost <= GRID_VALUES and n_cells * n_nodes >= LEAST_WALK


def tree_attributions(df: DataFrame, model, key: str | Sequence[str], features_col: str = "features",
                      model_path: str | None = None) -> DataFrame:
    """Per row: ``attributions`` (array, one per encoded feature), ``expected_value``
    and ``model_output`` (the sum of both).  ``key`` must tell the rows apart."""
    keys = [key] if isinstance(key, str) else list(key)
    nodes = tree_nodes(model, model_path)
    n_nodes, n_trees = nodes.agg(F.count(F.lit(1)), F.count_distinct("tree")).first()
    n_features = model.numFeatures
    grid = grid_of(nodes, n_features)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], cell(features_col, grid).alias("_cell"))
    found = materialize(rows.select("_cell").distinct())
    shards = max(1, min(n_trees, ceil(n_nodes / SHARD_NODES)))
    block = max(1, min(BLOCK_ROWS * min(shards, 4), BLOCK_VALUES // n_features))
    n_cells = found.count()
    by_grid = _grid_pays(grid, n_cells, n_nodes)
    if by_grid:  # a shard has its own grids, so shards are as few as keep all tasks at work
        slots = df.sparkSession.sparkContext.defaultParallelism
        shards, block = max(1, min(n_trees, max(slots, ceil(n_nodes / GRID_NODES)))), GRID_ROWS
    blocks = max(1, ceil(n_cells / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cut = found.withColumn("_block", F.pmod(F.xxhash64("_cell"), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))
    trees = nodes.withColumn("_shard", F.pmod("tree", F.lit(shards))).withColumn("_block", every(blocks))
    parts = min(3 * blocks * shards, 100_000)  # cogroups take long, so they aren't left to be merged by their bytes
    pairs = [t.repartition(parts, "_block", "_shard").groupBy("_block", "_shard") for t in (cut, trees)]
    schema = T.StructType([T.StructField("_cell", T.BinaryType()), T.StructField("_phi", T.ArrayType(T.DoubleType())),
                           T.StructField("_expected", T.DoubleType()), T.StructField("_output", T.DoubleType())])

    def run(own: pa.Table, shard: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        n = len(own)
        if not n:  # a block that no cell fell into
            return pa.table([own["_cell"], pa.array([], pa.list_(pa.float64())), pa.array([], pa.float64()),
                             pa.array([], pa.float64())], names=["_cell", "_phi", "_expected", "_output"])
        cells, trees = own["_cell"].combine_chunks(), trees_of(shard)
        phi, expected, output = (grid_attributions(codes_of(cells, grid), grid, trees) if by_grid and trees
                                 else ensemble_attributions(values_of(cells, grid), trees))
        made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_features),
                                        pa.array(np.ascontiguousarray(phi).ravel()))
        return pa.table([own["_cell"], made, pa.array(np.full(n, expected)), pa.array(output)],
                        names=["_cell", "_phi", "_expected", "_output"])

    got = pairs[0].cogroup(pairs[1]).applyInArrow(run, schema)
    if shards > 1:  # with one shard every cell is whole already
        got = got.groupBy("_cell").agg(
            F.array(*[F.sum(F.get("_phi", F.lit(i))) for i in range(n_features)]).alias("_phi"),
            F.sum("_expected").alias("_expected"), F.sum("_output").alias("_output"))
    return rows.join(got, "_cell").select(
        *[F.col(f"`{k}`") for k in keys], F.col("_phi").alias("attributions"),
        F.col("_expected").alias("expected_value"), F.col("_output").alias("model_output"))


def long_attributions(attr: DataFrame, feature_names: Sequence[str], key: str | Sequence[str],
                      values: DataFrame | None = None) -> DataFrame:
    """(key…, feature, contribution) — one row per encoded feature."""
    keys = [key] if isinstance(key, str) else list(key)
    names = F.array(*[F.lit(n) for n in feature_names])
    return attr.select(*keys, F.inline(F.arrays_zip(names.alias("feature"),
                                                     F.col("attributions").alias("contribution"))))


def global_importance(attr: DataFrame, feature_names: Sequence[str], key: str | Sequence[str]) -> DataFrame:
    """Features by mean |contribution| (and mean contribution), largest first."""
    long = long_attributions(attr, feature_names, key)
    return (long.groupBy("feature")
            .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
                 F.avg("contribution").alias("mean_contribution"))
            .orderBy(F.col("mean_abs_contribution").desc(), F.col("feature")))


def model_feature_importance(spark, model, feature_names: Sequence[str]) -> DataFrame:
    """MLlib's split-gain importances (the cheap alternative to attributions):
    (feature, importance), largest first.  One value per encoded feature."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(feature_names, imp)]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.col("importance").desc(), F.col("feature")))


def contribution_table(encoded: DataFrame, attr: DataFrame, feature_names: Sequence[str],
                       key: str, key_value, features_col: str = "features") -> DataFrame:
    """For one row: feature, encoded value, contribution — by |contribution| desc."""
    a = attr.where(F.col(key) == F.lit(key_value))
    e = encoded.where(F.col(key) == F.lit(key_value)).select(key, vector_to_array(F.col(features_col)).alias("_x"))
    names = F.array(*[F.lit(n) for n in feature_names])
    j = a.join(e, key)
    z = j.select(key, F.inline(F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"),
                                            F.col("attributions").alias("contribution"))))
    return z.orderBy(F.abs("contribution").desc(), F.col("feature"))

