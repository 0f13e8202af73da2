"""Models of all training rows: cells with counts, forests grown by a task a tree, registered queries."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from equiwatch.operators import cells as C
from equiwatch.operators import explain as X
from equiwatch.operators import forest as FO
from equiwatch.operators import models as MD
from equiwatch.plans import q_models as Q

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(5000, 3)), 3)
    out = [(i, *map(float, r), "uvw"[i % 3], int(r[0] + r[1] * (i % 3) + rng.normal() > 0), int(r[2] > 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(out, "id long, a double, b double, c double, kind string, label int, other int")


def _few_rounds(monkeypatch):
    real = MD.fit_target
    few = {"gbt": {"max_iter": 2}, "rf": {"num_trees": 8}}
    monkeypatch.setattr(MD, "fit_target", lambda *a, kind, **k: real(*a, kind=kind, **(few[kind] | k)))
    monkeypatch.setattr(Q, "_MEMO", {})


def test_registered_models_are_fitted_on_every_training_row(spark, monkeypatch):
    _few_rounds(monkeypatch)
    for kind in ("gbt", "rf"):
        data, _, _, models = Q.trained(spark, SF_SMALL, kind)
        n = data.where("split = 'train'").count()
        assert n == 4800
        for t in ("rts", "rtp"):
            covers = [r[0] for r in X.tree_nodes(models[t].model).where("node = 0").select("cover").collect()]
            assert len(covers) == (2 if kind == "gbt" else 8)
            if kind == "gbt":
                assert covers == [n] * 2
            else:  # each tree's own bootstrap of all rows, classes weighted alike
                assert abs(np.mean(covers) - n) < 0.05 * n


def test_attribution_queries_give_each_feature_its_contribution(spark, monkeypatch):
    _few_rounds(monkeypatch)
    for query, kind in ((Q.q_tree_attributions, "gbt"), (Q.q_forest_attributions, "rf")):
        got = {r["row_id"]: r for r in query(spark, SF_SMALL).collect()}
        _, attr, names = Q._attributions(spark, SF_SMALL, kind)
        assert len(got) == 6000
        for r in attr.where("row_id % 50 = 1").collect():
            own = got[r["row_id"]]
            assert [c["feature"] for c in own["attributions"]] == names
            assert np.allclose([c["contribution"] for c in own["attributions"]], r["attributions"], atol=1e-6)
            assert abs(sum(r["attributions"]) - own["attribution_sum"]) < 1e-5


def test_boosting_from_counted_cells_is_boosting_on_the_rows(spark, rows):
    tm = MD.fit_target(rows, "T", "label", ["a", "b", "c", "kind"], max_iter=5)
    enc = tm.encode(rows)
    grid = C.training_grid(enc, "features", tm.model.numFeatures)
    assert [len(p) for p in grid.points] == [31, 31, 31, 1, 1, 1]
    a = np.sort([r[0] for r in enc.select(F.get(vector_to_array("features"), F.lit(0))).collect()])
    assert (grid.points[0] == a[[-(-i * 5000 // 32) - 1 for i in range(1, 32)]]).all()  # exact, not of a sample
    whole = enc.withColumn("_cell", C.cell("features", grid)).select(
        "id", F.col("label").cast("double").alias("label"), array_to_vector(C.cell_codes("_cell", grid)).alias("features"))
    own = MD.train_gbt(whole.cache(), "label", max_iter=5, max_bins=101)
    a = {r[0]: r[1][1] for r in own.transform(whole).select("id", "probability").collect()}
    b = {r[0]: r[1] for r in tm.predict(rows).select("id", "prob").collect()}
    assert len(a) == 5000 and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def _best(codes, counts, weights, min_rows):
    """The largest fall of the Gini impurity by any feature and bin."""
    def gini_sum(k):
        w = k * np.array(weights)
        return (w ** 2).sum() / w.sum()

    best = 0.0
    for f in range(codes.shape[1]):
        for b in range(codes[:, f].max()):
            left = codes[:, f] <= b
            l, r = counts[left].sum(axis=0), counts[~left].sum(axis=0)
            if min(l.sum(), r.sum()) >= min_rows:
                whole = counts.sum(axis=0)
                best = max(best, (gini_sum(l) + gini_sum(r) - gini_sum(whole)) / (whole * np.array(weights)).sum())
    return best


def test_a_grown_tree_takes_the_best_splits_to_pure_leaves():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 6, size=(300, 4)).astype("u1")
    codes = np.unique(codes, axis=0)
    counts = rng.poisson(1.5, size=(len(codes), 2))
    weights, width = (0.8, 1.7), 4
    tree = FO.grow(codes, counts, weights, 6, np.random.default_rng(2), 30, 2, width)
    n = len(tree["left"])
    assert tree["left"][0] == 1 and n > 50
    todo, seen = [(0, np.arange(len(codes)))], 0
    while todo:
        node, rows = todo.pop()
        seen += 1
        own = counts[rows].sum(axis=0)
        assert abs(tree["cover"][node] - (own * weights).sum()) < 1e-9
        assert abs(tree["value"][node] - own[1] * weights[1] / (own * weights).sum()) < 1e-12
        best = _best(codes[rows], counts[rows], weights, 2) if min(own) else 0.0
        if tree["left"][node] < 0:
            assert best <= 1e-12
            continue
        assert abs(tree["gain"][node] - best) < 1e-12
        left = codes[rows, tree["feature"][node]] <= tree["bin"][node]
        todo += [(tree["left"][node], rows[left]), (tree["right"][node], rows[~left])]
    assert seen == n
    shallow = FO.grow(codes, counts, weights, 6, np.random.default_rng(2), 2, 2, width)
    assert len(shallow["left"]) == 7


def test_a_forest_is_saved_loaded_and_scored_in_shards(spark, rows, tmp_path, monkeypatch):
    tm = MD.fit_target(rows, "T", "label", ["a", "b", "c", "kind"], kind="rf", num_trees=20)
    want = {r[0]: (r[1], r[2]) for r in tm.predict(rows).select("id", "pred", "prob").collect()}
    assert sum(p == y for (p, _), y in zip((want[k] for k in sorted(want)), [r[0] for r in rows.orderBy("id").select("label").collect()],
                                           strict=True)) > 4000
    assert abs(sum(tm.model.featureImportances.toArray()) - 1) < 1e-9
    path = str(tmp_path / "forest")
    MD.save_target_model(tm, path)
    monkeypatch.setattr(FO, "BLOCK_ROWS", 500)
    back = MD.load_target_model(spark, path)
    got = {r[0]: (r[1], r[2]) for r in back.predict(rows).select("id", "pred", "prob").collect()}
    assert got == want
    with pytest.raises(ValueError, match="missing labels"):
        MD.fit_target(rows.withColumn("label", F.when(F.col("id") > 5, F.col("label"))), "T", "label", ["a"], kind="rf", num_trees=1)


def test_a_forest_of_too_many_cells_is_fitted_on_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(MD, "MAX_CELLS", 10)
    tm = MD.fit_target(rows, "T", "label", ["a", "kind"], kind="rf", num_trees=3, max_depth=4)
    assert tm.model.transform(tm.encode(rows)).where("probability IS NOT NULL").count() == 5000 and not isinstance(tm.model, FO.ForestModel)


def test_attributions_by_grids_equal_the_walk(spark, rows, monkeypatch):
    for kind, size in (("rf", {"num_trees": 6}), ("gbt", {"max_iter": 5})):
        tm = MD.fit_target(rows, "T", "label", ["a", "b", "c", "kind"], kind=kind, **size)
        some = tm.encode(rows).where("id % 10 = 0")
        walked = {r["id"]: r for r in X.tree_attributions(some, tm.model, "id").collect()}
        with monkeypatch.context() as m:
            m.setattr(X, "LEAST_WALK", 0)
            m.setattr(X, "GRID_NODES", 200)
            m.setattr(X, "GRID_ROWS", 300)
            m.setattr(X, "ensemble_attributions", None)  # not called
            for r in X.tree_attributions(some, tm.model, "id").collect():
                w = walked.pop(r["id"])
                assert np.allclose(r["attributions"], w["attributions"], atol=1e-12)
                assert abs(r["expected_value"] - w["expected_value"]) + abs(r["model_output"] - w["model_output"]) < 1e-12
        assert not walked
