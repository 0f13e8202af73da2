"""Preparation, models and tree attributions (additivity + brute-force Shapley)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equiwatch.operators import explain as X
from equiwatch.operators import models as MD
from equiwatch.operators import prep as P


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(3000).select(
        "id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 5).alias("b"), (F.rand(3) * 2).alias("c"),
        F.when(F.rand(4) < 0.5, "x").when(F.rand(5) < 0.5, "y").otherwise(None).alias("cat"))
    df = df.withColumn("a", F.when(F.col("id") % 17 == 0, None).otherwise(F.col("a")))
    return df.withColumn("label", ((F.col("b") + F.coalesce("a", F.lit(5.0)) / 2 + F.rand(6) * 2
                                    + F.when(F.col("cat") == "x", 1.0).otherwise(0.0)) > 6).cast("int"))


def test_prep_constants(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (10.0, None), (None, "a")], "x double, s string")
    pm = P.fit_prep(df, ["x", "s"])
    assert pm.medians["x"] == 2.5
    assert pm.modes["s"] == "a"            # tie a/b (2 each) → smallest
    assert pm.categories["s"] == ["a", "b"]
    vals = [r["f"] for r in pm.transform(df).select(vector_to_array("features").alias("f")).collect()]
    imputed = [1.0, 2.0, 3.0, 10.0, 2.5]
    mean = sum(imputed) / 5
    std = math.sqrt(sum((v - mean) ** 2 for v in imputed) / 5)   # population std
    assert all(abs(v[0] - (x - mean) / std) < 1e-12 for v, x in zip(vals, imputed))
    assert [v[1:] for v in vals] == [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]
    unseen = spark.createDataFrame([(1.0, "zzz")], "x double, s string")
    assert pm.transform(unseen).select(vector_to_array("features")).first()[0][1:] == [0.0, 0.0]


def _trees(model):
    return X.trees_of(X.tree_nodes(model).toArrow())


def _path_dependent_value(tree, x, subset, node=0):
    """Expected value of the tree when only the features of ``subset`` are known."""
    if tree.left[node] < 0:
        return float(tree.value[node])
    if tree.feature[node] in subset:
        left = bool(tree.goes_left(node, np.array(x)[:, None])[0])
        return _path_dependent_value(tree, x, subset, tree.left[node] if left else tree.right[node])
    return sum(share * _path_dependent_value(tree, x, subset, child) for child, _, share in tree.children(node))


def _brute_shapley(trees, x):
    nf = len(x)
    phi = np.zeros(nf)
    value = {s: sum(t.weight * _path_dependent_value(t, x, s) for t in trees)
             for k in range(nf + 1) for s in itertools.combinations(range(nf), k)}
    for i in range(nf):
        others = [j for j in range(nf) if j != i]
        for k in range(nf):
            for s in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(nf - k - 1) / math.factorial(nf)
                phi[i] += wgt * (value[tuple(sorted((*s, i)))] - value[s])
    return phi


def test_tree_attributions_exact(spark, data):
    tm = MD.fit_target(data, "T", "label", ["a", "b", "c", "cat"], kind="gbt", max_iter=4, max_depth=3)
    enc = tm.prep.transform(data)
    attr = X.tree_attributions(enc, tm.model, "id").orderBy("id").limit(40).collect()
    raw = {r["id"]: r["m"] for r in tm.model.transform(enc).select(
        "id", vector_to_array("rawPrediction").getItem(1).alias("m")).collect()}
    for r in attr:
        assert abs(sum(r["attributions"]) + r["expected_value"] - raw[r["id"]]) < 1e-6
    # Brute-force Shapley values on the path-dependent value function.
    trees = _trees(tm.model)
    xs = {r["id"]: r["x"] for r in enc.select("id", vector_to_array("features").alias("x")).orderBy("id").limit(5).collect()}
    for rid, x in xs.items():
        got = np.array(next(r["attributions"] for r in attr if r["id"] == rid))
        assert np.allclose(got, _brute_shapley(trees, x), atol=1e-9)


@pytest.mark.parametrize("codes", [1, 64, 2048])
def test_deep_trees_match_brute_force_shapley(spark, monkeypatch, codes):
    monkeypatch.setattr(X, "CODES", codes)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 6)), 1)
    rows = [(i, *map(float, r), "pqrs"[i % 4], int(r[0] * r[1] + r[2] - r[3] * (i % 4 == 1) > 0)) for i, r in enumerate(x)]
    cols = [f"x{k}" for k in range(6)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", kind string, label int")
    tm = MD.fit_target(df, "T", "label", [*cols, "kind"], kind="rf", num_trees=3, max_depth=12)
    enc = tm.encode(df)
    trees = _trees(tm.model)
    assert max(len(t.left) for t in trees) > 50
    xs = np.array([r[0] for r in enc.orderBy("id").select(vector_to_array("features")).limit(40).collect()])
    phi, expected, output = X.ensemble_attributions(xs, trees)
    for i in range(0, 40, 8):
        assert np.allclose(phi[i], _brute_shapley(trees, xs[i]), atol=1e-9)
        assert abs(sum(t.weight * _path_dependent_value(t, xs[i], range(xs.shape[1])) for t in trees) - output[i]) < 1e-9
    assert abs(sum(t.weight * _path_dependent_value(t, xs[0], ()) for t in trees) - expected) < 1e-9


def test_shards_and_blocks_add_up(spark, data, monkeypatch):
    tm = MD.fit_target(data, "T", "label", ["a", "b", "c", "cat"], kind="rf", num_trees=6, max_depth=6)
    enc = tm.encode(data)
    whole = {r["id"]: r for r in X.tree_attributions(enc, tm.model, "id").collect()}
    monkeypatch.setattr(X, "SHARD_NODES", 60)
    monkeypatch.setattr(X, "BLOCK_ROWS", 700)
    cut = X.tree_attributions(enc, tm.model, "id")
    assert "CoGroup" in cut._jdf.queryExecution().executedPlan().toString()
    for r in cut.collect():
        a = whole.pop(r["id"])
        assert np.allclose(r["attributions"], a["attributions"], atol=1e-12)
        assert abs(r["expected_value"] - a["expected_value"]) + abs(r["model_output"] - a["model_output"]) < 1e-12
    assert not whole


def test_forest_attributions_sum_to_probability(spark, data):
    tm = MD.fit_target(data, "T", "label", ["a", "b", "c", "cat"], kind="rf", num_trees=5, max_depth=4)
    enc = tm.prep.transform(data)
    attr = {r["id"]: r for r in X.tree_attributions(enc, tm.model, "id").collect()}
    probs = tm.predict(data).select("id", "prob").collect()
    for r in probs[:200]:
        a = attr[r["id"]]
        assert abs(sum(a["attributions"]) + a["expected_value"] - r["prob"]) < 1e-6


def test_deep_forest_attributions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 14))
    rows = [(i, *map(float, r), int(r[:6].sum() + rng.normal() > 0)) for i, r in enumerate(x)]
    cols = [f"x{k}" for k in range(14)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    tm = MD.fit_target(df, "T", "label", cols, kind="rf", num_trees=4, max_depth=30)
    assert max(len(set(t.feature[t.left >= 0])) for t in _trees(tm.model)) > 8
    for r in X.tree_attributions(tm.encode(df), tm.model, "id").collect():
        assert abs(sum(r["attributions"]) + r["expected_value"] - r["model_output"]) < 1e-6


def test_save_load_same_predictions(spark, data, tmp_path):
    tm = MD.fit_target(data, "T", "label", ["a", "b", "c", "cat"], kind="gbt", max_iter=3)
    path = str(tmp_path / "bundle")
    MD.save_target_model(tm, path)
    back = MD.load_target_model(spark, path)
    a = {r["id"]: (r["pred"], r["prob"]) for r in tm.predict(data).select("id", "pred", "prob").collect()}
    b = {r["id"]: (r["pred"], r["prob"]) for r in back.predict(data).select("id", "pred", "prob").collect()}
    assert a == b


def test_all_null_numeric_column_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, z double")
    pm = P.fit_prep(df, ["x", "z"])
    assert pm.feature_names == ["num__x"]


def test_vector_metadata_has_feature_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    pm = P.fit_prep(df, ["x", "s"])
    meta = pm.transform(df).schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for group in meta.values() for a in group), key=lambda a: a["idx"])]
    assert names == ["num__x", "txt__s__hot_a", "txt__s__hot_b"] and pm.feature_names == ["num__x", "cat__s_a", "cat__s_b"]


def test_money_text_trains_as_a_number_and_a_reloaded_bundle_scores_raw_rows(spark, tmp_path):
    rows = [(i, f" ${i % 50},000 ", "yes" if i % 3 else "no\n", float(i % 7), int(i % 50 > 25)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, pay string, flag string, x double, label int")
    tm = MD.fit_target(df, "T", "label", ["pay", "flag", "x"], max_iter=3)
    assert tm.cleaning.rules == {"pay": "numeric", "flag": "boolish"}
    assert tm.prep.numeric == ["pay", "flag", "x"] and tm.prep.categorical == []
    path = str(tmp_path / "bundle")
    MD.save_target_model(tm, path)
    back = MD.load_target_model(spark, path)
    assert (back.prep.medians, back.prep.moments, back.prep.modes, back.prep.categories, back.cleaning.rules) == (
        tm.prep.medians, tm.prep.moments, tm.prep.modes, tm.prep.categories, tm.cleaning.rules)
    a, b = (sorted((r["id"], r["prob"]) for r in m.predict(df).select("id", "prob").collect()) for m in (tm, back))
    assert a == b
    with pytest.raises(ValueError, match="not binary"):
        MD.fit_target(df.withColumn("label", F.col("id")), "T", "label", ["x"], max_iter=1)


def test_rows_of_a_cell_are_scored_and_attributed_once(spark, data, monkeypatch):
    """Copies and near copies of a row share its cell: attributions are worked out per cell, and scores stay the model's own."""
    from equiwatch.operators.cells import cell, grid_of

    for kind, size in (("gbt", {"max_iter": 4}), ("rf", {"num_trees": 5, "max_depth": 6})):
        tm = MD.fit_target(data, "T", "label", ["a", "b", "c", "cat"], kind=kind, **size)
        many = data.limit(300).crossJoin(spark.range(4).select(F.col("id").alias("copy")))
        near = many.withColumn("c", F.col("c") + F.col("copy") * 1e-13)
        enc = tm.encode(near)
        grid = grid_of(X.tree_nodes(tm.model), tm.model.numFeatures)
        assert enc.select(cell("features", grid).alias("x")).distinct().count() <= 310
        rows = X.tree_attributions(enc, tm.model, ["id", "copy"])
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("CoGroup")  # the cogroups come before the rows do
        got = {(r["id"], r["copy"]): r for r in rows.collect()}
        own = {(r["id"], r["copy"]): (int(r["prediction"]), float(r["probability"][1])) for r in tm.model.transform(enc).select(
            "id", "copy", "prediction", "probability").collect()}
        pred = {(r["id"], r["copy"]): (r["pred"], r["prob"]) for r in tm.predict(near).select("id", "copy", "pred", "prob").collect()}
        assert pred == own and len(got) == 1200
        xs = np.array([r[0] for r in enc.orderBy("id", "copy").select(vector_to_array("features")).collect()])
        phi, _, output = X.ensemble_attributions(xs, _trees(tm.model))
        assert np.allclose([got[k]["attributions"] for k in sorted(got)], phi, atol=1e-12)
        assert np.allclose([got[k]["model_output"] for k in sorted(got)], output, atol=1e-12)


def test_grid_codes_tell_apart_what_splits_do():
    from equiwatch.operators.cells import Grid

    grid = Grid(4, [0, 2], [np.array([-1.0, 0.5]), np.array([0.0, 1.0, 2.0])], [False, True])
    x = np.array([[-1.0, 9, 0, 9], [-0.9, 8, 1, 8], [0.5, 7, 2, 7], [0.6, 0, 5, 0], [np.nan, 0, -3, 0], [np.inf, 0, 0.5, 0]])
    codes = grid.codes(x)
    assert codes.tolist() == [[0, 0], [1, 1], [1, 2], [2, 3], [2, 3], [2, 3]]
    back = grid.values(codes)
    assert (grid.codes(back) == codes).all() and back.shape == x.shape
