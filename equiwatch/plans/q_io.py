"""Registered source/sink queries (SRC-1, SRC-2, SINK-1, SINK-3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fairness as fz
from ..session import scratch_path
from ..sources import csv as CSV
from ..sources import sinks as SK
from ..sources.tables import table
from .q_fairness import _BATCH, _SUMMARY, _batch_report
from .registry import finish, register


@register("read_parquet", "SRC-2", "SELECT * FROM orders")
def q_read_parquet(spark, sf):
    return table(spark, sf, "orders")


@register("read_parquet_filtered", "SRC-2", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem
WHERE l_extendedprice >= 20000.0 AND l_discount < 0.05 AND l_linenumber <> 2
""")
def q_read_parquet_filtered(spark, sf):
    rows = table(spark, sf, "lineitem", where=[("l_extendedprice", ">=", 20000.0), ("l_discount", "<", 0.05),
                                               ("l_linenumber", "<>", 2)])
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@register("read_csv_infer", "SRC-1", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def q_read_csv_infer(spark, sf):
    # The table is written as CSV by Spark into the shared scratch folder, then
    # read back with header + type inference + the encoding/NA rules.
    path = scratch_path(spark, "customer-csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return CSV.read_csv_infer(spark, path)


_HIST_SCHEMA = T.StructType([T.StructField("batch", T.LongType()), T.StructField("max_dp_diff", T.DoubleType()),
                             T.StructField("max_eo_diff", T.DoubleType()), T.StructField("alert", T.BooleanType())])


@register("history_export", "SINK-1", _BATCH + f", {_SUMMARY} "
          "SELECT batch, round(max_dp_diff, 6) AS max_dp_diff, round(max_eo_diff, 6) AS max_eo_diff, alert FROM summary")
def q_history_export(spark, sf):
    path = scratch_path(spark, "history-csv")
    SK.export_history_csv(fz.batch_summary(_batch_report(spark, sf)), path)
    back = spark.read.option("header", True).schema(_HIST_SCHEMA).csv(path)
    return finish(back)


@register("history_append", "SINK-3", _BATCH + f", {_SUMMARY} "
          "SELECT batch, round(max_dp_diff, 6) AS max_dp_diff, round(max_eo_diff, 6) AS max_eo_diff, alert, "
          "'007' AS run_id FROM summary")
def q_history_append(spark, sf):
    path = scratch_path(spark, "history-table")
    summary = finish(fz.batch_summary(_batch_report(spark, sf)))
    SK.append_history(summary, path, "007", epoch=0)
    SK.append_history(summary, path, "007", epoch=0)   # a replayed epoch: no duplicates
    back = SK.read_history(spark, path)
    return back.select("batch", "max_dp_diff", "max_eo_diff", "alert", "run_id")
