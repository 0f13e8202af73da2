"""Hand-worked examples for cleaning, labels, sampling, ordering, health, metrics."""

import math

import pytest
from pyspark.sql import functions as F

from equiwatch.functions import columns as C
from equiwatch.operators import cleaning as CL
from equiwatch.operators import health as H
from equiwatch.operators import labels as L
from equiwatch.operators import metrics as M
from equiwatch.operators import names as N
from equiwatch.operators import ordering as O
from equiwatch.operators import sampling as SM
from equiwatch.operators.smoothing import ema


def test_bins(spark):
    vals = [0.0, 18.0, 18.5, 22.0, 36.0, 121.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(C.bin_column("x")).collect()]
    assert got == ["<=18", "<=18", "19-22", "19-22", "36+", None, None]


def test_boolish_threshold(spark):
    df = spark.createDataFrame([("Yes",), ("no",), ("TRUE",), ("maybe",), (None,)], "s string")
    assert CL.fit_cleaning(df).rules["s"] == "keep"          # 3/5 = 0.6, not above
    df2 = spark.createDataFrame([("Yes",), ("no",), ("TRUE",), ("maybe",)], "s string")
    rules = CL.fit_cleaning(df2)
    assert rules.rules["s"] == "boolish"
    assert [r[0] for r in rules.transform(df2).collect()] == [1, 0, 1, None]


def test_numeric_strings(spark):
    df = spark.createDataFrame([("$1,200",), ("45%",), (" 1e3 ",), ("12",), ("x",)], "s string")
    rules = CL.fit_cleaning(df)
    assert rules.rules["s"] == "numeric"
    assert [r[0] for r in rules.transform(df).collect()] == [1200.0, 45.0, 1000.0, 12.0, None]
    df2 = spark.createDataFrame([("1200",), ("45",), ("x",), ("y",), ("z",)], "s string")
    assert CL.fit_cleaning(df2).rules["s"] == "keep"


def test_lenient_numbers_rejected(spark):
    df = spark.createDataFrame([(v,) for v in ["12d", "5f", "nan", "0x1", "1_0", ""]], "s string")
    assert all(r[0] is None for r in df.select(C.parse_number("s")).collect())


def test_nan_is_missing(spark):
    from equiwatch.sources.tables import normalize_missing
    df = normalize_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert [r[0] for r in df.collect()] == [1.0, None, None]


def test_health_example(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "x int, s string")
    h = H.dataset_health(df).collect()[0]
    assert (h["rows"], h["cols"]) == (5, 2)
    assert math.isclose(h["missing_pct"], 20.0) and math.isclose(h["dup_pct"], 60.0)
    assert h["target_pos_rate"] is None
    t = spark.createDataFrame([(1,), (0,), (1,), (1,)], "y int")
    assert H.dataset_health(t, "y").collect()[0]["target_pos_rate"] == 75.0
    t2 = spark.createDataFrame([(1,), (None,)], "y int")
    assert H.dataset_health(t2, "y").collect()[0]["target_pos_rate"] is None
    empty = spark.createDataFrame([], "y int")
    e = H.dataset_health(empty, "y").collect()[0]
    assert (e["rows"], e["cols"], e["target_pos_rate"]) == (0, 1, None)


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    for method in ("exact", "distributed"):
        assert L.percentiles(df, {"m": (F.col("x"), 0.5)}, method).collect()[0]["m"] == 2.5


def test_gate(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (0, 0)], "rts int, rtp int")
    assert [r["rtp"] for r in L.label_gate(df).collect()] == [0, 1, 0, 0]


def test_name_discovery():
    cols = ["age", "fatigue_score", "performance_score", "acl_risk_score"]
    assert N.find_col_contains(cols, N.PERFORMANCE_KEYWORDS) == "fatigue_score"
    assert N.find_col_contains(cols, N.PERFORMANCE_KEYWORDS, prefer="keyword") == "performance_score"
    assert N.find_col_regex(["x_time", "recovery"], N.RECOVERY_PATTERNS) == "recovery"
    m = N.default_mapping(["id", "race", "gender", "rts", "rtp", "Fatigue_Score"])
    assert (m.rts_target, m.rtp_target, m.protected, m.drop) == ("rts", "rtp", ("race", "gender"),
                                                               ("id", "Fatigue_Score"))


def test_batches(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    b = SM.assign_batches(df, ["k"], 100)
    sizes = sorted((r["batch"], r["count"]) for r in b.groupBy("batch").count().collect())
    assert sizes == [(1, 100), (2, 100), (3, 50)]
    first = b.where("position = 1").collect()[0]
    assert first["k"] == 0 and first["batch"] == 1


def test_global_rank_matches_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    ranked = O.global_rank(df, ["k"], partitions=7).collect()
    assert sorted((r["k"], r["row_id"]) for r in ranked) == [(i, i + 1) for i in range(1000)]


def test_stratified_split_counts(spark):
    df = spark.range(15000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = SM.stratified_split(df, "id", "y", 0.2, 42)
    assert s.where("split = 'test'").count() == 3000
    by = {r["y"]: r["count"] for r in s.where("split = 'test'").groupBy("y").count().collect()}
    assert by == {1: 750, 0: 2250}


def test_ema(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2)], "batch long, v double")
    got = [round(r["v_smoothed"], 10) for r in ema(df, ["v"]).orderBy("batch").collect()]
    assert got == [0.1, 0.15, 0.1625]


def test_ema_long_series_matches_recurrence(spark):
    import random
    rnd = random.Random(3)
    vals = [rnd.random() for _ in range(300)]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(vals)], "batch long, v double")
    got = [r["v_smoothed"] for r in ema(df, ["v"], block=8).orderBy("batch").collect()]
    s, want = None, []
    for v in vals:
        s = v if s is None else 0.25 * v + 0.75 * s
        want.append(s)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_ema_off_the_happy_path(spark):
    rows = [("a", 5, 0.1), ("a", 9, 0.3), ("a", 10, 0.2), (None, 1, 1.0), (None, 2, None), (None, 3, 2.0)]
    df = spark.createDataFrame(rows, "s string, batch long, v double")
    for block in (1, 2, 4096):
        got = {(r["s"], r["batch"]): r["v_smoothed"] for r in ema(df, ["v"], series=["s"], block=block).collect()}
        assert [round(got["a", b], 10) for b in (5, 9, 10)] == [0.1, 0.15, 0.1625]
        assert [got[None, b] for b in (1, 2, 3)] == [1.0, 1.0, 1.25]
    one = {r["batch"]: r["v_smoothed"] for r in ema(df.where("s = 'a'"), ["v"], alpha=1.0, block=2).collect()}
    assert one == {5: 0.1, 9: 0.3, 10: 0.2}
    runs = spark.createDataFrame([(2, 1, 3.0), (1, 1, 1.0), (1, 2, 2.0)], "run long, batch long, v double")
    out = {(r["run"], r["batch"]): r["v_smoothed"] for r in ema(runs, ["v"], step=["run", "batch"]).collect()}
    assert out == {(1, 1): 1.0, (1, 2): 1.25, (2, 1): 1.6875}


def test_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 2), ("a", 1), (None, 1), ("a", 2)], "g string, k int")
    got = sorted(((r["g"] or "", r["k"], r["row_id"]) for r in O.global_rank(df, ["k"], groups=["g"]).collect()))
    assert got == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 2, 2)]


def test_white_space_is_stripped(spark):
    from equiwatch.functions import columns as C
    df = spark.createDataFrame([("\tyes\n",), ("\t12\n",), ("\u00a0$1,000\r",)], "t string")
    got = [(r[0], r[1], r[2]) for r in df.select(C.boolish_value("t"), C.parse_number("t"), C.is_boolish("t")).collect()]
    assert got == [(1, None, True), (None, 12.0, False), (None, 1000.0, False)]


def test_attr_summary_rounds_ties_to_even(spark):
    from equiwatch.operators import fairness as fz
    df = spark.createDataFrame([(1, "a", 0.0625, 0.1875)], "batch int, protected_attr string, dp_diff double, eo_diff double")
    r = fz.attr_summary(df).first()
    assert (r["dp"], r["eo"]) == (0.062, 0.188)


def test_duplicates_by_digest(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("a", "a", float("nan")), ("a", "a", float("nan")),
            ("aa", "", None), ("a", "a", None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    want = 100.0 * (len(rows) - 5) / len(rows)
    assert abs(H.dup_pct(df).first()[0] - want) < 1e-9
    h = H.dataset_health(df).first()
    assert abs(h["dup_pct"] - want) < 1e-9 and abs(h["missing_pct"] - 100.0 * 7 / 21) < 1e-9
    plan = H.dataset_health(df)._jdf.queryExecution().executedPlan().toString()
    assert all("x#" not in line and "y#" not in line for line in plan.splitlines() if "Exchange hash" in line)


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert M.roc_auc(df, "y", "s").collect()[0]["auc"] == 0.75
    same = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert M.roc_auc(same, "y", "s").collect()[0]["auc"] == 0.5
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert M.roc_auc(one, "y", "s").collect()[0]["auc"] is None


def test_binary_target_check(spark):
    CL.binary_target_check(spark.createDataFrame([("1",), ("0",), (None,)], "t string"), "t")
    CL.binary_target_check(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "t double"), "t")
    with pytest.raises(ValueError):
        CL.binary_target_check(spark.createDataFrame([(2,), (0,)], "t int"), "t")


def test_percentile_methods_agree(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003 / 7.0).alias("x"), (F.col("id") % 13).alias("y"))
    specs = {"p1": (F.col("x"), 0.35), "p2": (F.col("y"), 0.8), "p3": (F.col("x"), 0.5)}
    exact = L.percentiles(df, specs, "exact").first().asDict()
    dist = L.percentiles(df, specs, "distributed").first().asDict()
    assert exact == dist == L.percentiles(df, specs).first().asDict()


def test_mode_ties_smallest(spark):
    from equiwatch.operators import prep as P
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "y"), ("a", None)], "s string, t string")
    assert P.modes(df, ["s", "t"]) == {"s": "a", "t": "x"}


def test_column_types(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double")
    assert [tuple(r) for r in H.column_types(df).collect()] == [("i", "int"), ("s", "string"), ("d", "double")]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=30))
def test_gated_rtp_never_exceeds_rts(spark, pairs):
    df = spark.createDataFrame(pairs, "rts int, rtp int")
    out = L.label_gate(df).collect()
    assert all(r["rtp"] <= r["rts"] for r in out)


@settings(max_examples=8, deadline=None)
@given(n=st.integers(1, 400), size=st.integers(1, 120))
def test_batch_sizes_sum_to_n(spark, n, size):
    b = SM.assign_batches(spark.range(n), ["id"], size)
    counts = {r["batch"]: r["count"] for r in b.groupBy("batch").count().collect()}
    assert sum(counts.values()) == n
    assert all(c == size for k, c in counts.items() if k < max(counts))
    assert max(counts) == -(-n // size)


def test_hot_value_is_split_across_range_partitions(spark):
    # A third of the rows share one score; ranks and AUC stay exact.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") / 3000.0).alias("s"),
                                  (F.col("id") % 2).cast("int").alias("y"))
    auc = M.roc_auc(df, "y", "s").first()["auc"]
    rows = [(r["y"], r["s"]) for r in df.collect()]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12
    q = L.percentiles(df, {"m": (F.col("s"), 0.5)}, "distributed").first()["m"]
    assert q == L.percentiles(df, {"m": (F.col("s"), 0.5)}, "exact").first()["m"]


def test_constants_are_subqueries_not_joins(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("performance_score"))
    out = L.rts_rule_percentile(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "Subquery" in plan
    several = spark.range(2000).select(F.col("id").cast("double").alias("performance_score"),
                                       F.col("id").alias("fatigue_score"), F.col("id").alias("load_balance_score"))
    rule = L.rtp_rule_percentile(several)
    rule.collect()
    ran = rule._jdf.queryExecution().executedPlan().toString()
    assert ran.split("Initial Plan")[0].count("ReusedSubquery") >= 2  # three thresholds, one aggregate
    vals = sorted(r[0] for r in df.collect())
    pos = 0.55 * (len(vals) - 1)
    lo, hi = int(pos), min(int(pos) + 1, len(vals) - 1)
    p55 = vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)
    assert out.where("rts = 1").count() == sum(v >= p55 for v in vals)


def test_running_sums_match_a_window(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 3).cast("string").alias("g"),
                                  F.when(F.col("id") % 4 > 0, F.col("id") - 1500).alias("v"),
                                  (F.col("id") / 8).alias("d")).withColumn("g", F.when(F.col("g") != "1", F.col("g")))
    out = O.running_sums(df, ["k"], {"v_sum": "v", "d_sum": F.col("d") * 2}, groups=["g"], partitions=7)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("v_sum"), F.sum(F.col("d") * 2).over(w).alias("d_sum"))
    assert out.columns == want.columns and out.schema["v_sum"].dataType.simpleString() == "bigint"
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    hot = spark.range(500).select(F.lit(1).alias("v"), F.col("id"))
    assert {r["s"] for r in O.running_sums(hot, ["v", "id"], {"s": "v"}).collect()} == set(range(1, 501))
    assert O.running_sums(hot.limit(0), ["v"], {"s": "v"}).collect() == []
    with pytest.raises(Exception, match="range of bigint|long overflow"):
        O.running_sums(spark.createDataFrame([(1, 2**62), (2, 2**62)], "k int, v long"), ["k"], {"s": "v"}).collect()


def test_ema_of_many_series_over_partitions(spark):
    import random
    rnd = random.Random(5)
    rows = [(s, t, rnd.choice([None, float("nan"), rnd.random(), rnd.random()]), rnd.random())
            for s, n in (("long", 700), (None, 90), *((f"s{i}", 1 + i % 4) for i in range(60))) for t in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, t int, v double, w double")
    want = {}
    for s, t, v, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        old_v, old_w = want.get((s, t - 1), (None, None))
        if v is not None and v == v:
            old_v = v if old_v is None else 0.3 * v + 0.7 * old_v
        want[s, t] = old_v, x if old_w is None else 0.3 * x + 0.7 * old_w
    for block in (3, 64):
        out = ema(df, ["v", "w"], step="t", series=["s"], alpha=0.3, block=block, partitions=9)
        got = {(r["s"], r["t"]): (r["v_smoothed"], r["w_smoothed"]) for r in out.collect()}
        assert set(got) == set(want)
        for k in want:
            for a, b in zip(got[k], want[k]):
                assert a == b or abs(a - b) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
