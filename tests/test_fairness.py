"""Hand-worked fairness examples (FIXTURES §3) and property tests."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equiwatch.operators import fairness as fz

T1 = [fz.Target("RTS", "y", "p")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, p int")


ROWS_A = [("A", 1, 1), ("A", 1, 0), ("A", 0, 1), ("A", 0, 0)]
ROWS_B = [("B", 1, 1), ("B", 0, 0)]
ROWS_C = [("C", 0, 0)]


def _gaps(spark, rows, thr=0.10):
    rep = fz.fairness_report(_frame(spark, rows), T1, ["g"], threshold=thr).collect()
    assert len(rep) == 1
    return rep[0]


def test_group_rates(spark):
    rates = {r["grp"]: r for r in fz.group_report(_frame(spark, ROWS_A + ROWS_B + ROWS_C), T1, ["g"]).collect()}
    assert (rates["A"]["n"], rates["A"]["selection_rate"], rates["A"]["tpr"], rates["A"]["fpr"]) == (4, 0.5, 0.5, 0.5)
    assert (rates["B"]["tpr"], rates["B"]["fpr"], rates["B"]["accuracy"]) == (1.0, 0.0, 1.0)
    assert (rates["C"]["selection_rate"], rates["C"]["tpr"], rates["C"]["accuracy"]) == (0.0, 0.0, 1.0)


def test_gaps_two_groups(spark):
    r = _gaps(spark, ROWS_A + ROWS_B)
    assert (r["dp_diff"], r["eo_diff"], r["alert"]) == (0.0, 0.5, True)


def test_gaps_three_groups(spark):
    r = _gaps(spark, ROWS_A + ROWS_B + ROWS_C)
    assert (r["dp_diff"], r["eo_diff"], r["alert"]) == (0.5, 1.0, True)


def test_single_group_no_gap(spark):
    r = _gaps(spark, ROWS_A)
    assert (r["dp_diff"], r["eo_diff"], r["alert"], r["n_groups"]) == (0.0, 0.0, False, 1)


def test_alert_is_strict(spark):
    r = _gaps(spark, ROWS_A + ROWS_B, thr=0.5)
    assert r["eo_diff"] == 0.5 and r["alert"] is False


def test_null_group_label(spark):
    df = spark.createDataFrame([(None, 1, 1), ("A", 0, 0)], "g string, y int, p int")
    groups = {r["grp"] for r in fz.confusion_by_group(df, T1, ["g"]).collect()}
    assert groups == {"A", "Unknown"}


def test_missing_protected_raises(spark):
    with pytest.raises(ValueError):
        fz.fairness_report(_frame(spark, ROWS_A), T1, ["nope"])
    with pytest.raises(ValueError):
        fz.fairness_report(_frame(spark, ROWS_A), T1, [])


def test_worst_driver_tie_and_driver(spark):
    rep = spark.createDataFrame(
        [(1, "RTS", "race", 0.2, 0.3), (1, "RTP", "race", 0.3, 0.1), (2, "RTS", "race", 0.05, 0.05)],
        "batch long, target string, attribute string, dp_diff double, eo_diff double",
    ).withColumn("protected_attr", F.concat_ws(":", "target", "attribute"))
    w = {r["batch"]: r for r in fz.worst_driver(rep, 0.10, ["batch"]).collect()}
    assert w[1]["protected_attr"] == "RTS:race" and w[1]["driver"] == "Equalized Odds"
    assert w[2]["driver"] == "Demographic Parity" and w[2]["stable"] is True


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.08,), (0.10,), (0.25,)], "severity double")
    got = [(r["mood"], round(r["severity_pct"], 6), r["status"]) for r in
           fz.severity_bands(df, 0.10).orderBy("severity").collect()]
    assert got == [("good", 50.0, "OK"), ("warn", 80.0, "OK"), ("warn", 100.0, "OK"), ("bad", 100.0, "ALERT")]


def test_plan_has_two_exchanges_no_single_partition(spark):
    from equiwatch.plans.views import ORDERS_PROTECTED, orders_scored
    rep = fz.fairness_report(orders_scored(spark, "/root/testdata/sf0.001"), protected=ORDERS_PROTECTED)
    plan = rep._jdf.queryExecution().executedPlan().toString()
    # Before AQE runs, the plan shows the shuffles it intends to run.
    assert plan.count("Exchange hashpartitioning") >= 2
    assert "SinglePartition" not in plan


rows_strategy = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 1), st.integers(0, 1)),
                         min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(rows=rows_strategy)
def test_report_properties(spark, rows):
    df = spark.createDataFrame(rows, "g string, y int, p int")
    conf = fz.confusion_by_group(df, T1, ["g"])
    assert sum(r["n"] for r in conf.collect()) == len(rows)
    rep = fz.fairness_report(df, T1, ["g"]).collect()[0]
    assert 0.0 <= rep["dp_diff"] <= 1.0 and 0.0 <= rep["eo_diff"] <= 1.0
    # Independent of row order and partition count.
    rep2 = fz.fairness_report(df.repartition(3).orderBy(F.rand(1)), T1, ["g"]).collect()[0]
    assert (rep["dp_diff"], rep["eo_diff"]) == (rep2["dp_diff"], rep2["eo_diff"])
    # Renaming groups leaves the gaps unchanged.
    renamed = df.withColumn("g", F.concat(F.lit("x_"), F.coalesce("g", F.lit("Unknown"))))
    rep3 = fz.fairness_report(renamed, T1, ["g"]).collect()[0]
    assert (rep["dp_diff"], rep["eo_diff"]) == (rep3["dp_diff"], rep3["eo_diff"])


def test_high_cardinality_warning(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("pid"), (F.col("id") % 2).cast("string").alias("g"))
    with pytest.warns(UserWarning):
        assert fz.warn_high_cardinality(df, ["pid", "g"]) == ["pid"]
