"""Tree-ensemble classifiers per target, prediction, gating, persistence.

Defaults follow the monitored application: gradient boosting with 250 trees,
step 0.05, depth 3, seed 42; random forest with 300 trees, leaves of at least
2 rows, balanced class weights, seed 42, depth up to 30 (Spark's limit).

Training sees a row only through its bins (32 a feature at most, from exact order
statistics of all rows), so the rows are counted once by cell and class and fitted from
these counts, every row with its weight: boosting by MLlib (distributed histogram split
search), a forest by ``forest`` (a task a tree).  Past ``MAX_CELLS`` cells a forest is
MLlib's own, on the rows.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Grid, cell, cell_codes, cell_values, grid_of, training_grid
from .cleaning import CleaningRules, binary_target_check, fit_cleaning
from .explain import tree_nodes
from .forest import ForestModel, train_forest
from .ordering import materialize, written
from .prep import PrepModel, fit_prep
from ..session import scratch_path

#: Cells that a forest's tasks hold at most (a byte a feature and two counts each).
MAX_CELLS = 1 << 22
#: Cells of a partition when boosting is fitted.
CELLS_A_TASK = 50_000


def class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Balanced weights n / (classes · n_class), attached by a join with the
    per-class counts (one row per class; Spark picks the join)."""
    counts = df.groupBy(F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_ncls"))
    tot = counts.agg(F.sum("_ncls").alias("_n"), F.count(F.lit(1)).alias("_k"))
    from .constants import with_constants
    w = with_constants(counts, tot).select("_cls", (F.col("_n") / (F.col("_k") * F.col("_ncls"))).alias(out))
    return df.join(w, df[label] == w["_cls"], "left").drop("_cls")


def train_gbt(train: DataFrame, label: str, features_col: str = "features", max_iter: int = 250,
              step_size: float = 0.05, max_depth: int = 3, seed: int = 42,
              checkpoint_interval: int = 10, weight_col: str | None = None, max_bins: int = 32) -> GBTClassificationModel:
    # Boosting rounds grow the lineage; MLlib checkpoints every
    # ``checkpoint_interval`` rounds into the shared checkpoint folder.
    from ..session import checkpoint_dir
    checkpoint_dir(train.sparkSession)
    gbt = GBTClassifier(labelCol=label, featuresCol=features_col, maxIter=max_iter, stepSize=step_size,
                        maxDepth=max_depth, seed=seed, checkpointInterval=checkpoint_interval, maxBins=max_bins,
                        cacheNodeIds=True, **({"weightCol": weight_col} if weight_col else {}))
    return gbt.fit(train)


@dataclass
class BinnedRows:
    """Training rows counted by cell: the columns n0_i and n1_i have those of the classes of label i."""

    grid: Grid
    cells: DataFrame
    labels: list[str]
    n_cells: int

    def counts(self, label: str) -> tuple[str, str]:
        i = self.labels.index(label)
        return f"n0_{i}", f"n1_{i}"


def bin_rows(enc: DataFrame, labels: Sequence[str], n_features: int, features_col: str = "features") -> BinnedRows:
    """All encoded rows counted by the cells of their own training grid."""
    grid = training_grid(enc, features_col, n_features)
    y = [F.col(f"`{c}`").cast("double") for c in labels]
    bad = enc.agg(*[F.count_if(v.isNull() | F.isnan(v)) for v in y]).first()
    if any(bad):
        raise ValueError(f"missing labels in the training rows: {dict(zip(labels, bad, strict=True))}")
    counted = enc.select(cell(features_col, grid).alias("_cell"), *[v.alias(f"_y{i}") for i, v in enumerate(y)]).groupBy("_cell").agg(
        *[F.count_if(F.col(f"_y{i}") == k).alias(f"n{k}_{i}") for i in range(len(y)) for k in (0, 1)])
    cells = written(counted, "training-cells")
    return BinnedRows(grid, cells, list(labels), cells.count())


def _boosted(binned: BinnedRows, label: str, **params) -> GBTClassificationModel:
    """Boosting fitted on the cells' codes, weighted by their rows; its thresholds are set back to the features' own."""
    spark, grid, (n0, n1) = binned.cells.sparkSession, binned.grid, binned.counts(label)
    each = F.inline(F.array(*[F.struct(F.lit(float(k)).alias("label"), F.col(n).cast("double").alias("weight")) for k, n in ((0, n0), (1, n1))]))
    codes = binned.cells.withColumn("codes", cell_codes("_cell", grid)).select("codes", each).where("weight > 0")
    place = {f: k for k, f in enumerate(grid.features)}  # features that never differ stay in the vector
    wide = F.array(*[F.get("codes", F.lit(place[f])) if f in place else F.lit(0.0) for f in range(grid.n_features)])
    parts = max(1, min(spark.sparkContext.defaultParallelism, 2 * binned.n_cells // CELLS_A_TASK + 2))
    rows = codes.select(array_to_vector(wide).alias("features"), "label", "weight").repartition(parts).cache()
    try:
        # MLlib looks for split points in max_bins² rows at least: in all of them here.
        bins = max(32, math.isqrt(2 * binned.n_cells) + 1)
        model = train_gbt(rows, "label", weight_col="weight", max_bins=bins, **params)
    finally:
        rows.unpersist()
    return _with_points(spark, model, grid)


def _with_points(spark, model: GBTClassificationModel, grid: Grid) -> GBTClassificationModel:
    """The model with its thresholds between two codes replaced by the split points there."""
    fitted, path = scratch_path(spark, "fitted-on-codes"), scratch_path(spark, "fitted")
    model.write().overwrite().save(fitted)
    points = {f: p.tolist() for f, p in zip(grid.features, grid.points, strict=True)}
    table = F.array(*[F.array(*[F.lit(v) for v in points.get(f, [])]).cast("array<double>") for f in range(grid.n_features)])
    split = F.col("nodeData.split")
    own = F.transform(split["leftCategoriesOrThreshold"], lambda t: F.get(F.get(table, split["featureIndex"]), F.floor(t).cast("int")))
    own = F.when(split["featureIndex"] >= 0, own).otherwise(split["leftCategoriesOrThreshold"])
    data = spark.read.parquet(os.path.join(fitted, "data"))
    data.withColumn("nodeData", F.col("nodeData").withField("split.leftCategoriesOrThreshold", own)).write.parquet(os.path.join(path, "data"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("metadata", "treesMetadata"):
        a, b = (jvm.org.apache.hadoop.fs.Path(os.path.join(p, part)) for p in (fitted, path))
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return GBTClassificationModel.load(path)


def train_rf(train: DataFrame, label: str, features_col: str = "features", num_trees: int = 300,
             max_depth: int = 30, min_instances_per_node: int = 2, seed: int = 42,
             balanced: bool = True) -> RandomForestClassificationModel:
    data = class_weights(train, label) if balanced else train
    rf = RandomForestClassifier(labelCol=label, featuresCol=features_col, numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_instances_per_node, seed=seed,
                                featureSubsetStrategy="sqrt",
                                **({"weightCol": "class_weight"} if balanced else {}))
    return rf.fit(data)


@dataclass
class TargetModel:
    """A target's fitted preparation + classifier (the saved bundle)."""

    target: str
    label: str
    prep: PrepModel
    model: GBTClassificationModel | RandomForestClassificationModel | ForestModel
    features: list[str]
    cleaning: CleaningRules = field(default_factory=CleaningRules)
    _grid: Grid | None = field(default=None, repr=False, compare=False)

    def encode(self, df: DataFrame) -> DataFrame:
        """Raw rows with the training rows' cleaning rules, and their feature vector."""
        return self.prep.transform(self.cleaning.transform(df))

    def grid(self) -> Grid:
        """The model's cells (read once from its nodes)."""
        if self._grid is None:
            self._grid = self.model.grid if isinstance(self.model, ForestModel) else grid_of(tree_nodes(self.model), self.model.numFeatures)
        return self._grid

    def score(self, vectors: DataFrame, pred_col: str = "pred", prob_col: str = "prob") -> DataFrame:
        """Hard class and P(class = 1) of rows with a feature vector."""
        out = self.model.transform(vectors)
        return (out.withColumn(pred_col, F.col("prediction").cast("int"))
                   .withColumn(prob_col, vector_to_array(F.col("probability")).getItem(1))
                   .drop("rawPrediction", "probability", "prediction"))

    def predict(self, df: DataFrame, pred_col: str = "pred", prob_col: str = "prob") -> DataFrame:
        """The encoded rows with hard class and P(class = 1)."""
        return predict_each(df, [(self, pred_col, prob_col)])


def predict_each(df: DataFrame, models: Sequence[tuple[TargetModel, str, str]]) -> DataFrame:
    """Rows encoded as by the last of ``models``, with each one's (model, class column, P(class = 1) column).

    Every cell that occurs (the values no split of the models tells apart) is scored once
    by the models themselves, and its scores are joined to its rows.
    """
    vector = "features"
    rows, same = df, None
    for i, (tm, _, _) in enumerate(models):
        if same is not tm.prep:  # models of one fit share their preparation
            rows = tm.encode(rows.drop(vector, *same.made_columns()) if same else rows)
            same = tm.prep
        rows = rows.withColumn(f"_cell{i}", cell(vector, tm.grid()))
    names = [f"_cell{i}" for i in range(len(models))]
    scored = rows.select(*names).distinct()
    if any(isinstance(tm.model, ForestModel) for tm, _, _ in models):
        scored = materialize(scored)  # counted, met by the trees, and joined to their sums
    for i, (tm, pred_col, prob_col) in enumerate(models):
        if isinstance(tm.model, ForestModel):
            probs = tm.model.score_cells(scored.select(names[i]).distinct(), names[i], prob_col)
            scored = scored.join(probs, names[i]).withColumn(pred_col, (F.col(prob_col) > 0.5).cast("int"))
            continue
        scored = scored.withColumn(vector, array_to_vector(cell_values(f"_cell{i}", tm.grid())))
        scored = tm.score(scored, pred_col, prob_col).drop(vector)
    return rows.join(scored, names).drop(*names)


def fit_target(train: DataFrame, target: str, label: str, features: Sequence[str], kind: str = "gbt",
               prep: PrepModel | None = None, cleaning: CleaningRules | None = None,
               binned: BinnedRows | None = None, **params) -> TargetModel:
    """Check the target, fit cleaning rules, preparation and classifier on all raw training rows.

    ``binned``: the rows' cells, where several targets or kinds share them.
    """
    binary_target_check(train, label)
    rules = cleaning or fit_cleaning(train, features)
    p = prep or fit_prep(rules.transform(train), features)
    binned = binned or bin_rows(p.transform(rules.transform(train)), [label], len(p.feature_names))
    if kind == "gbt":
        model = _boosted(binned, label, **params)
    elif binned.n_cells <= MAX_CELLS:
        model = train_forest(binned.cells, binned.grid, binned.counts(label), **params)
    else:
        enc = p.transform(rules.transform(train).withColumn(label, F.col(f"`{label}`").cast("double"))).cache()
        try:
            model = train_rf(enc, label, **params)
        finally:
            enc.unpersist()
    return TargetModel(target, label, p, model, list(features), rules)


def predict_gated(df: DataFrame, rts_pred: str = "rts_pred", rtp_pred: str = "rtp_pred") -> DataFrame:
    """RTP prediction is 1 only if both predictions are 1."""
    return df.withColumn(rtp_pred, ((F.col(rts_pred) == 1) & (F.col(rtp_pred) == 1)).cast("int"))


def save_target_model(tm: TargetModel, path: str) -> None:
    """Persist the bundle: ``prep/`` and ``model/`` in MLlib format + metadata JSON."""
    tm.prep.pipeline.write().overwrite().save(os.path.join(path, "prep"))
    if isinstance(tm.model, ForestModel):
        tm.model.save(os.path.join(path, "model"))
    else:
        tm.model.write().overwrite().save(os.path.join(path, "model"))
    meta = {"target": tm.target, "label": tm.label, "features": tm.features,
            "feature_names": tm.prep.feature_names, "numeric": tm.prep.numeric,
            "categorical": tm.prep.categorical, "medians": tm.prep.medians, "moments": tm.prep.moments,
            "modes": tm.prep.modes, "categories": tm.prep.categories, "cleaning": tm.cleaning.rules,
            "kind": {GBTClassificationModel: "gbt", ForestModel: "forest"}.get(type(tm.model), "rf")}
    from pyspark.sql import SparkSession
    SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "bundle"))


def load_target_model(spark, path: str) -> TargetModel:
    meta = json.loads(spark.read.text(os.path.join(path, "bundle")).first()[0])
    pipe = PipelineModel.load(os.path.join(path, "prep"))
    cls = {"gbt": GBTClassificationModel, "forest": ForestModel}.get(meta["kind"], RandomForestClassificationModel)
    model = cls.load(os.path.join(path, "model"))
    moments = {c: tuple(v) for c, v in meta["moments"].items()}
    prep = PrepModel(meta["numeric"], meta["categorical"], meta["medians"], moments, meta["modes"],
                     meta["categories"], meta["feature_names"], pipe)
    return TargetModel(meta["target"], meta["label"], prep, model, meta["features"], CleaningRules(meta["cleaning"]))
