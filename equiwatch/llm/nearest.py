"""Approximate nearest neighbours: stable low-dimensional projections in kd-trees.

Gaussian projections are 2-stable: over the projections, the squared projected
distance of two vectors at distance ``d`` is ``d**2`` times a chi-square variable
of ``dims`` degrees of freedom.  A search takes candidates in the order of
projected distance from a kd-tree, verifies each with its true distance, and
stops when a candidate at the distance of the current k-th neighbour would have
been seen by now with probability ``confidence`` (the chi-square test).

A small kd-tree fitted on a bounded sample of projected rows (``SAMPLE``) divides the
projected space into at most ``CELLS`` cells; every row is indexed in its cell, and
cells of many rows are cut into parts of about ``SHARD_ROWS`` rows, a kd-tree each.
A query searches a part of its own cell first.  Its k-th distance there bounds the
rest: it goes on only to the cells whose box of projections passes the chi-square
test at that distance.  Rows of cells that no query goes on to are not moved again.

Equal vectors are searched once, as queries and as candidates: of those, the ``k + 1``
smallest ids can be among anyone's nearest, and queries of one vector share their
``k + 1`` nearest, from which each leaves itself out.  The driver holds the sample's
projections, and a box and counts a cell.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components takes no part, nor does a null id; rows of one id count as one vector
(the least of their arrays); vectors of another length are not compared; fewer
than ``k`` candidates give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import materialize
from .arrowtext import tidy

DIMS, CONFIDENCE, SEED = 8, 0.97, 23
SHARD_ROWS, BLOCK_ROWS, LEAF = 16384, 2048, 64
#: Cells of the projected space at most, and rows that its division is fitted on (about).
CELLS, SAMPLE = 4096, 65536


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - exp(-x / 2) * total


def chi_square_point(p: float, dims: int) -> float:
    """Where the distribution reaches ``p``."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of a kd-tree over projected points: runs of ``order`` and their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, runs, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            own = points[order[lo:hi]]
            spread = np.ptp(own, axis=0)
            axis = int(spread.argmax())
            if hi - lo <= leaf or spread[axis] == 0:
                runs.append((lo, hi))
                continue
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.runs = order, runs
        self.low = np.array([points[order[a:b]].min(0) for a, b in runs])
        self.high = np.array([points[order[a:b]].max(0) for a, b in runs])

    def leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their boxes, and those distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        away = (gap * gap).sum(1)
        by = np.argsort(away, kind="stable")
        return by, away[by]


def planes(size: int, dims: int, seed: int = SEED) -> np.ndarray:
    """The projections of vectors of ``size`` components."""
    return np.random.default_rng(seed).standard_normal((size, dims))


def ruled_out(away: np.ndarray, worst: float, enough: float) -> np.ndarray:
    """Whether a candidate ``away`` (squared, projected) is too far to be nearer than ``worst`` (squared, true)."""
    return away >= enough * worst if worst > 0 else away > 0


def slack(point: np.ndarray) -> float:
    """Equal vectors' projections may differ in the last bits."""
    return 1e-9 * (1.0 + float(point @ point))


class Shard:
    """Vectors of one part of a cell in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int = DIMS, confidence: float = CONFIDENCE,
                 seed: int = SEED):
        self.planes, self.enough = planes(vectors.shape[1], dims, seed), chi_square_point(confidence, dims)
        self.tree = KdTree(vectors @ self.planes)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
        """(query id, vector id, distance) of the ``k`` nearest found up to each query's squared limit."""
        for own, q, limit, p in zip(query_ids.tolist(), queries, limits.tolist(), queries @ self.planes, strict=True):
            by, away = self.tree.leaves(p)
            away = np.maximum(0.0, away - slack(p))
            best_d, best_id = np.zeros(0), np.zeros(0, self.ids.dtype)
            lo, step = 0, 2
            while lo < len(by):
                worst = min(limit, best_d[-1]) if len(best_d) == k else limit
                if ruled_out(away[lo], worst, self.enough):
                    break
                rows = np.concatenate([np.arange(*self.tree.runs[leaf]) for leaf in by[lo:lo + step].tolist()])
                gap = self.vectors[rows] - q
                d = np.concatenate((best_d, (gap * gap).sum(1)))
                i = np.concatenate((best_id, self.ids[rows]))
                keep = np.lexsort((i, d))[:k]
                best_d, best_id = d[keep], i[keep]
                lo, step = lo + step, min(32, step * 2)
            for i, d in zip(best_id.tolist(), best_d.tolist(), strict=True):
                if d <= limit:
                    yield own, i, d ** 0.5


class Division:
    """A balanced kd-tree over a sample of projections; its leaves are the cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            if node >= len(self.axis) or not len(own):
                continue
            axis = int(np.ptp(own, axis=0).argmax())
            cut = float(np.median(own[:, axis]))
            self.axis[node], self.cut[node] = axis, cut
            right = own[:, axis] > cut
            todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return _numbers(column.flatten()).reshape(len(column), -1)


def _projected(rows: DataFrame, dims: int, division: Division | None) -> DataFrame:
    """``id``, ``v`` and ``size`` of the rows with their projections ``p`` and their ``cell``."""
    def run(batches):
        for b in batches:
            sizes = _numbers(b.column(2))
            points, first = np.zeros((len(b), dims)), {}
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                first[size] = planes(size, dims)
                points[at] = _matrix(b.column(1).take(pa.array(at))) @ first[size]
            cell = np.zeros(len(b), np.int64) if division is None else division.cells(points)
            flat = pa.array(points.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * dims, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(cell, pa.int64())],
                                             names=["id", "v", "size", "p", "cell"])
    return rows.select("id", "v", "size").mapInArrow(
        tidy(run), "id bigint, v array<double>, size int, p array<double>, cell bigint")


def _divided(rows: DataFrame, n: int, dims: int) -> Division | None:
    """Cells of about ``SHARD_ROWS`` rows, from the rows of the least hashes."""
    depth = min((CELLS - 1).bit_length(), (ceil(n / SHARD_ROWS) - 1).bit_length()) if n else 0
    if not depth:
        return None
    share = int(min(1.0, SAMPLE / n) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < share)
    points = _projected(some, dims, None).select("p").toPandas()["p"]
    return Division(np.array(points.tolist()).reshape(-1, dims), depth)


def _found(queries: DataFrame, points: DataFrame, layout: DataFrame, tasks: int, k: int, dims: int,
           confidence: float) -> DataFrame:
    """``qid``, ``id``, ``score``: the ``k`` nearest in each (cell, part) that a query is sent to.

    ``queries``: cell, part, id, v, size, limit; ``layout``: parts and blocks of queries of each cell.
    """
    pick = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    names = ("cell", "part", "block", "size", "kind", "id", "v", "limit")
    candidates = points.join(layout, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), pick("blocks").alias("block"), "size",
        F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("limit"))
    asked = queries.join(layout, "cell").select(
        "cell", "part", F.pmod(F.xxhash64(F.lit(SEED), "id"), "blocks").alias("block"), "size",
        F.lit(1).alias("kind"), "id", "v", "limit")
    units = (asked.unionByName(candidates).select(*names).repartition(min(max(1, tasks), 100_000), *names[:3])
             .sortWithinPartitions(*names[:6]))

    def run(batches):
        now, held, shard = None, [], None
        for b in batches:
            mark = np.column_stack([_numbers(b.column(i)).astype(np.int64) for i in range(5)])
            edges = (np.flatnonzero((np.diff(mark, axis=0) != 0).any(1)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
                if hi == lo:
                    continue
                unit, own = tuple(mark[lo, :4].tolist()), b.slice(lo, hi - lo)
                if unit != now:
                    now, held, shard = unit, [], None
                ids, vectors = _numbers(own.column(5)), _matrix(own.column(6))
                if mark[lo, 4] == 0:
                    held.append((ids, vectors))
                    continue
                if shard is None and held:
                    shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), dims, confidence)
                    held = []
                if shard is not None:
                    got = list(shard.search(ids, vectors, _numbers(own.column(7)), k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                        names=["qid", "id", "score"])

    return units.mapInArrow(tidy(run), "qid bigint, id bigint, score double")


def _sent_on(queries: DataFrame, boxes: dict, dims: int, confidence: float) -> DataFrame:
    """A row for every part of every cell that the chi-square test at the query's limit leaves, but the searched one.

    ``queries``: id, v, size, p, cell, part, limit; ``boxes``: cell, parts, low and high of each cell.
    """
    enough = chi_square_point(confidence, dims)

    def run(batches):
        for b in batches:
            points, limits = _matrix(b.column(3)), _numbers(b.column(6))
            done = np.column_stack([_numbers(b.column(4)), _numbers(b.column(5))])
            for j, (p, limit) in enumerate(zip(points, limits.tolist(), strict=True)):
                gap = np.maximum(np.maximum(boxes["low"] - p, p - boxes["high"]), 0.0)
                away = np.maximum(0.0, (gap * gap).sum(1) - slack(p))
                near = np.flatnonzero(~ruled_out(away, limit, enough))
                parts = boxes["parts"][near]
                cell = np.repeat(boxes["cell"][near], parts)
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                new = (cell != done[j, 0]) | (part != done[j, 1])
                own = b.slice(j, 1).take(pa.array(np.zeros(int(new.sum()), np.int64)))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[new]), pa.array(part[new]), own.column(0), own.column(1), own.column(2),
                         own.column(6)], names=["cell", "part", "id", "v", "size", "limit"])

    return queries.select("id", "v", "size", "p", "cell", "part", "limit").mapInArrow(
        tidy(run), "cell bigint, part bigint, id bigint, v array<double>, size int, limit double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's ``k`` nearest found."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                           F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("is_query"))
            .where(F.col("id").isNotNull() & usable(F.col("v")))
            .groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 equals 0.0
            .withColumn("size", F.size("v")))
    rows = materialize(rows)
    of_vector = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    division = _divided(rows, rows.count(), dims)
    points = rows.withColumn("copy", of_vector).where(F.col("copy") <= k + 1)
    points = materialize(_projected(points, dims, division))
    asking = rows.where("is_query").groupBy("v").agg(F.min("id").alias("id")).withColumn("size", F.size("v"))
    asking = materialize(_projected(asking, dims, division))

    ends = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").toPandas()
    boxes = {"cell": cells["cell"].to_numpy(np.int64),
             "parts": np.ceil(cells["n"].to_numpy() / SHARD_ROWS).astype(np.int64),
             "low": cells[[f"low{i}" for i in range(dims)]].to_numpy(),
             "high": cells[[f"high{i}" for i in range(dims)]].to_numpy()}
    parts_of = dict(zip(boxes["cell"].tolist(), boxes["parts"].tolist(), strict=True))

    def layout(sent: dict) -> tuple[DataFrame, int]:
        """Parts of each cell and blocks of the queries that each part gets (at most ``CELLS`` rows), and tasks."""
        table = [(c, p, ceil(sent[c] / BLOCK_ROWS)) for c, p in parts_of.items() if sent.get(c)]
        return (F.broadcast(spark.createDataFrame(table, "cell bigint, parts bigint, blocks bigint")),
                sum(p * b for _, p, b in table))

    cell_parts = F.broadcast(spark.createDataFrame(list(parts_of.items()), "cell bigint, parts bigint"))
    # a cell of the sample may hold no row, and copies of a vector may lie on both sides of a cut
    asking = asking.join(cell_parts, "cell", "left").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("bigint"))))
    first = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    table, tasks = layout(first)
    found = _found(asking.withColumn("limit", F.lit(float("inf"))), points, table, tasks, k + 1, dims, confidence)
    if boxes["parts"].sum() > 1:
        found = materialize(found)
        full = (found.groupBy("qid").agg(F.count(F.lit(1)).alias("got"), F.max("score").alias("worst"))
                .where(F.col("got") > k).select(F.col("qid").alias("id"), "worst"))
        limit = F.coalesce(F.col("worst") * F.col("worst") * (1 + 1e-12), F.lit(float("inf")))
        on = materialize(_sent_on(asking.join(full, "id", "left").withColumn("limit", limit), boxes, dims, confidence))
        most = on.groupBy("cell", "part").count().groupBy("cell").agg(F.max("count").alias("n"))
        more = {r["cell"]: r["n"] for r in most.collect()}
        table, tasks = layout(more)
        found = found.unionByName(_found(on, points, table, tasks, k + 1, dims, confidence))

    best = Window.partitionBy("qid").orderBy("score", "id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    named = (rows.where("is_query").select(F.col("id").alias("query_id"), "v")
             .join(asking.select("v", F.col("id").alias("qid")), "v").select("query_id", "qid"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return (named.join(top, "qid").where(F.col("id") != F.col("query_id")).withColumn("rank", place)
            .where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 100 == 0)
