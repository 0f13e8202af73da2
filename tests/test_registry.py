"""Registered queries against their DuckDB oracle on the smallest tables, plus
stream restarts and the driver contract."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from equiwatch.sources.tables import TABLES

from .conftest import SF_SMALL

SAMPLE = ["fairness_report", "fairness_by_batch", "ema_smooth", "worst_driver", "dataset_health",
          "coerce_numeric", "composite_label", "stratified_split", "global_rank", "roc_auc_ties",
          "fairness_window", "impute_mode", "history_export", "read_csv_infer", "fairness_stream"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _rows(cols, cur.fetchall())


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 80


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 6 and "dp_diff" in df.columns


def test_stream_restart_is_idempotent(spark):
    from equiwatch.operators import fairness as fz
    from equiwatch.plans.q_fairness import replay
    from equiwatch.plans.views import ORDERS_PROTECTED
    from equiwatch.session import scratch_path
    from equiwatch.streaming import monitor as SM

    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-sink", "t-ckpt"))
    rows = replay(spark, SF_SMALL).drop("draw", "position")
    for g in range(2):
        rows.where(F.col("batch") % 2 == g).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):   # the second start finds nothing new in the checkpoint
        q = SM.fairness_stream(SM.file_stream(spark, src, schema), sink, ckpt,
                               protected=ORDERS_PROTECTED, keys=["batch"], run_id="r", details=True)
        q.awaitTermination()
    out = spark.read.parquet(sink)
    batch = fz.fairness_report(rows, protected=ORDERS_PROTECTED, keys=["batch"])
    assert out.count() == batch.count()
    assert out.select("epoch_id").distinct().count() == 2
    groups = fz.group_report(rows, protected=ORDERS_PROTECTED, keys=["batch"])
    assert spark.read.parquet(sink + "_groups").count() == groups.count()
    key = ["batch", "max_dp_diff", "max_eo_diff", "alert"]
    assert (sorted(map(tuple, spark.read.parquet(sink + "_summary").select(*key).collect()))
            == sorted(map(tuple, fz.batch_summary(batch).select(*key).collect())))
    assert spark.read.parquet(sink + "_worst").count() == batch.select("batch").distinct().count()


def test_stream_row_batches_inside_micro_batches(spark):
    from equiwatch.plans.views import ORDERS_PROTECTED, orders_scored
    from equiwatch.session import scratch_path
    from equiwatch.streaming import monitor as SM

    src, sink, ckpt = (scratch_path(spark, n) for n in ("rb-src", "rb-sink", "rb-ckpt"))
    rows = orders_scored(spark, SF_SMALL)
    rows.coalesce(1).write.parquet(src)
    q = SM.fairness_stream(SM.file_stream(spark, src, spark.read.parquet(src).schema), sink, ckpt,
                           run_id="r", protected=ORDERS_PROTECTED, batch_size=500, order_by=["o_orderkey"])
    q.awaitTermination()
    out = spark.read.parquet(sink)
    n = rows.count()
    assert out.select("batch").distinct().count() == -(-n // 500)


def test_late_rows_change_no_state(spark):
    from equiwatch.session import scratch_path
    from equiwatch.streaming import monitor as SM
    src, sink, ckpt = (scratch_path(spark, n) for n in ("late-src", "late-sink", "late-ckpt"))
    for rows in ([("r", 1, 0.1), ("r", 2, 0.3)], [("r", 2, 9.0), ("r", 3, 0.2)]):
        spark.createDataFrame(rows, "run string, batch long, v double").coalesce(1).write.mode("append").parquet(src)
    stream = SM.file_stream(spark, src, spark.read.parquet(src).schema)
    q = (SM.ema_stream(stream, ["v"], ["run"]).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["batch"], r["v"], r["v_smoothed"] and round(r["v_smoothed"], 10)) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 0.1, 0.1), (2, 0.3, 0.15), (2, 9.0, None), (3, 0.2, 0.1625)]
    with pytest.raises(ValueError):
        SM.ema_stream(stream, ["v"], [])


def test_registry_imports_without_a_session():
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "print(len(E.queries()), len(E.oracle_sql()))" % E.__file__.rsplit("/", 1)[0])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n_q, n_sql = map(int, out.stdout.split())
    assert n_q >= 80 and n_sql >= 70
