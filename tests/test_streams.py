"""Streams that stop between writes, batches over micro-batches, late steps; pushed filters and exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from equiwatch.operators import fairness as fz
from equiwatch.operators import prep as P
from equiwatch.operators import sampling as SM
from equiwatch.operators.smoothing import ema
from equiwatch.plans.views import ORDERS_PROTECTED, orders_scored
from equiwatch.session import scratch_path
from equiwatch.sources.tables import read_parquet
from equiwatch.streaming import monitor as M

SF = "/root/testdata/sf0.001"


def _files(spark, frames, name):
    src = scratch_path(spark, name)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    return M.file_stream(spark, src, spark.read.parquet(src).schema)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_an_epoch_shows_when_its_last_write_is_done(spark, monkeypatch):
    rows = orders_scored(spark, SF)
    stream = _files(spark, [rows.where(F.col("o_orderkey") % 2 == k) for k in range(2)], "kill-src")
    sink, ckpt = scratch_path(spark, "kill-sink"), scratch_path(spark, "kill-ckpt")
    write, calls = M._write_epoch, []

    def dies(df, path, run_id, epoch_id):
        calls.append(path)
        if epoch_id == 1 and len(calls) == 8:  # epoch 0 makes five writes; two tables of epoch 1 are written
            raise RuntimeError("lost")
        write(df, path, run_id, epoch_id)

    monkeypatch.setattr(M, "_write_epoch", dies)

    def run():
        q = M.fairness_stream(stream, sink, ckpt, "007", protected=ORDERS_PROTECTED, details=True)
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert spark.read.parquet(sink).select("epoch_id").distinct().count() == 2
    for table in ("", "_summary", "_worst", "_groups"):
        assert {r["epoch_id"] for r in M.read_committed(spark, sink, table).collect()} == {0}
    monkeypatch.setattr(M, "_write_epoch", write)
    run()
    key = ("target", "attribute", "n_groups", "dp_diff", "eo_diff", "alert")
    for k in range(2):
        # files arrive in the order they were written
        want = fz.fairness_report(rows.where(F.col("o_orderkey") % 2 == k), protected=ORDERS_PROTECTED)
        assert _rows(M.read_committed(spark, sink).where(F.col("epoch_id") == k), *key) == _rows(want, *key)
    for table in ("_summary", "_worst", "_groups"):
        assert {r["epoch_id"] for r in M.read_committed(spark, sink, table).collect()} == {0, 1}
    assert {r["run_id"] for r in M.read_committed(spark, sink).collect()} == {"007"}
    assert [r["rows"] for r in M.committed(spark, sink).orderBy("epoch_id").collect()] == [
        rows.where(F.col("o_orderkey") % 2 == k).count() for k in range(2)]


def test_batches_go_on_over_micro_batches(spark):
    rows = orders_scored(spark, SF).orderBy("o_orderkey").limit(1003)
    rows = SM.assign_batches(rows, ["o_orderkey"], 100).drop("batch")
    cuts = (0, 130, 131, 160, 777, 1003)  # a batch may hold rows of three micro-batches
    frames = [rows.where((F.col("position") > lo) & (F.col("position") <= hi)) for lo, hi in zip(cuts, cuts[1:])]
    stream = _files(spark, frames, "go-src")
    sink, ckpt = scratch_path(spark, "go-sink"), scratch_path(spark, "go-ckpt")
    for _ in range(2):
        M.fairness_stream(stream, sink, ckpt, "r", protected=ORDERS_PROTECTED, batch_size=100, order_by=["position"],
                          details=True).awaitTermination()
    whole = SM.assign_batches(rows.drop("position"), ["o_orderkey"], 100)
    key = ("batch", "target", "attribute", "n_groups", "dp_diff", "eo_diff", "alert")
    want = fz.fairness_report(whole, protected=ORDERS_PROTECTED, keys=["batch"])
    assert _rows(M.read_committed(spark, sink, latest_by=["batch"]), *key) == _rows(want, *key)
    counts = ("batch", "target", "attribute", "grp", "n", "tp", "tn", "fp", "fn")
    groups = fz.confusion_by_group(whole, protected=ORDERS_PROTECTED, keys=["batch"])
    assert _rows(M.read_committed(spark, sink, "_groups", latest_by=["batch"]), *counts) == _rows(groups, *counts)


def test_shuffled_steps_equal_the_batch_smoothing(spark):
    rng = random.Random(4)
    rows = [(run, t, rng.random()) for run in ("a", "b") for t in range(40)]
    near = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))  # up to six steps late
    schema = "run string, batch long, v double, ts timestamp"

    def frame(part):
        return spark.createDataFrame(part, "run string, batch long, v double").select(
            "run", "batch", "v", F.timestamp_seconds(F.col("batch") * 60 + 86400).alias("ts"))

    frames = [frame(near[i:i + 10]) for i in range(0, 80, 10)] + [frame([("end", 10_000 + k, 0.0)]) for k in range(2)]
    out, ckpt = scratch_path(spark, "shuffled-sink"), scratch_path(spark, "shuffled-ckpt")
    stream = _files(spark, frames, "shuffled-src")
    assert [f.dataType.simpleString() for f in stream.schema.fields] == [c.split()[1].replace("long", "bigint") for c in schema.split(", ")]
    smooth = M.ema_stream(stream, ["v"], ["run"], alpha=0.3, event_time="ts", delay="10 minutes")
    (smooth.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    want = ema(spark.createDataFrame(rows, "run string, batch long, v double"), ["v"], series=["run"], alpha=0.3)
    rounded = [F.round(c, 9) for c in ("v", "v_smoothed")]
    assert _rows(spark.read.parquet(out).where("run <> 'end'"), "run", "batch", *rounded) == _rows(want, "run", "batch", *rounded)


def test_comparisons_of_doubles_reach_the_reader(spark):
    path = scratch_path(spark, "nan-table")
    values = [None, float("nan"), -1.0, 0.0, 2.5, 7.0, float("inf")]
    spark.createDataFrame([(i, v, str(i)) for i, v in enumerate(values)], "k int, x double, s string").write.parquet(path)
    for sign in ("=", "<>", "<", "<=", ">", ">="):
        where = [("x", sign, 2.5), ("s", "<>", "6")]
        df = read_parquet(spark, path, where=where)
        plain = read_parquet(spark, path).where(f"x {sign} 2.5 AND s <> '6'")
        assert _rows(df, "k", "x") == _rows(plain, "k", "x")
        pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("]")[0]
        assert "(x,2.5)" in pushed and "(s,6)" in pushed


def test_exact_counts_without_ranking_all_rows(spark):
    df = spark.range(4001).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = SM.stratified_split(df, "id", "y", 0.2, 42)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange rangepartitioning" not in plan
    draws = SM.with_draw(df, "id", 42).collect()
    for y in (0, 1):
        own = sorted((r["draw"], r["id"]) for r in draws if r["y"] == y)
        got = {r["id"] for r in out.where((F.col("y") == y) & (F.col("split") == "test")).collect()}
        assert got == {i for _, i in own[:len(got)]}
    assert out.where("split = 'test'").count() == 801
    tied = spark.range(900).select((F.col("id") % 3).alias("k"), "id")  # three draws in all
    kept = SM.sample_fraction(tied, "k", 0.4, 7, exact=True, key_order=["k", "id"])
    assert kept.count() == 360 and kept.columns == ["k", "id", "draw"]
    by = {r["k"]: r["count"] for r in kept.groupBy("k").count().collect()}
    assert sorted(by.values()) == [60, 300]
    part = min(by, key=by.get)
    assert {r["id"] for r in kept.where(F.col("k") == part).collect()} == {part + 3 * i for i in range(60)}
    assert SM.stratified_split(df.limit(0), "id", "y").collect() == []
    assert SM.sample_fraction(df, "id", 0.0, exact=True).count() == 0


def test_slots_of_values_as_a_table(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "b", "c", "a", "zz"])], "id int, v string")
    slots = P.category_slots(df.where("id < 6"), "v")
    assert _rows(slots, "value", "slot") == [("a", 0), ("b", 1), ("c", 2)]
    got = P.with_slot(df, "v", slots)
    assert got.columns == ["id", "v", "v__slot"]
    assert {r["id"]: r["v__slot"] for r in got.collect()} == {0: 1, 1: 0, 2: None, 3: 1, 4: 2, 5: 0, 6: None}
