"""Registered streaming queries (FAIR-13..15).

Stream sources are files Spark writes from the test tables into the shared
scratch folder; each query runs its stream to completion (``availableNow``)
and returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as fz
from ..operators.ordering import materialize
from ..session import scratch_path
from ..streaming import monitor as SM
from . import sqltext as S
from .q_fairness import _BATCH, _REPORT_COLS, _SUMMARY, _ema_sql, replay
from .registry import finish, register
from .views import EVENTS_PROTECTED, ORDERS_PROTECTED, events_scored

N_STEPS = 4


def _feed(df, path: str, order, by: str | None = None, n_steps: int = N_STEPS) -> None:
    """Write ``df`` in ``n_steps`` append jobs in the order of ``order`` (a number;
    NULL first), so that a file source sees it in that order.  Within a job the
    rows are dealt by ``by``, whose values then lie in one file each."""
    df = materialize(df)  # every step reads it
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    step = F.coalesce(F.least(F.floor((order - F.lit(lo)) * n_steps / F.lit(hi - lo + 1)), F.lit(n_steps - 1)), F.lit(0))
    tagged = df.withColumn("_step", step)
    for k in range(n_steps):
        part = tagged.where(F.col("_step") == k).drop("_step")
        (part.repartition(by) if by else part).write.mode("append").parquet(path)


@register("fairness_stream", "FAIR-13", _BATCH + f"SELECT batch, {_REPORT_COLS} FROM report")
def q_fairness_stream(spark, sf):
    return finish(SM.read_committed(spark, _run_monitor(spark, sf)).select(
        "batch", "target", "attribute", "n_groups", "dp_diff", "eo_diff", "protected_attr", "alert"))


def _run_monitor(spark, sf) -> str:
    """The replay fed in order of its batches (a batch lies in one file); returns the sink."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    _feed(replay(spark, sf).drop("draw", "position"), src, F.col("batch"), "batch")
    stream = SM.file_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=8)
    q = SM.fairness_stream(stream, sink, ckpt, "run-1", protected=ORDERS_PROTECTED, keys=["batch"], details=True)
    q.awaitTermination()
    return sink


@register("fairness_stream_summary", "FAIR-13", _BATCH + f", {_SUMMARY} "
          "SELECT batch, round(max_dp_diff, 6) AS max_dp_diff, round(max_eo_diff, 6) AS max_eo_diff, alert FROM summary")
def q_fairness_stream_summary(spark, sf):
    out = SM.read_committed(spark, _run_monitor(spark, sf), "_summary")
    return finish(out.select("batch", "max_dp_diff", "max_eo_diff", "alert"))


@register("fairness_stream_groups", "FAIR-13", _BATCH + """
SELECT batch, target, attribute, grp, n, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr,
       round(fpr, 6) AS fpr, round(accuracy, 6) AS accuracy FROM rates
""")
def q_fairness_stream_groups(spark, sf):
    out = SM.read_committed(spark, _run_monitor(spark, sf), "_groups")
    return finish(out.select("batch", "target", "attribute", "grp", "n", "selection_rate", "tpr", "fpr", "accuracy"))


@register("fairness_stream_batches", "BATCH-1 (stream)", _BATCH + f"SELECT batch, {_REPORT_COLS} FROM report")
def q_fairness_stream_batches(spark, sf):
    """The replay's rows in draw order over micro-batches that cut its batches anywhere; batches are made by the stream."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("batch-src", "batch-sink", "batch-ckpt"))
    rows = replay(spark, sf).drop("batch")
    n = rows.count()
    for k in range(N_STEPS):
        lo, hi = (n * 7 * k // (7 * N_STEPS), n * 7 * (k + 1) // (7 * N_STEPS))
        rows.where((F.col("position") > lo) & (F.col("position") <= hi)).coalesce(1).write.mode("append").parquet(src)
    stream = SM.file_stream(spark, src, spark.read.parquet(src).schema)
    SM.fairness_stream(stream, sink, ckpt, "run-1", protected=ORDERS_PROTECTED, batch_size=100,
                       order_by=["position"]).awaitTermination()
    return finish(SM.read_committed(spark, sink, latest_by=["batch"]).select(
        "batch", "target", "attribute", "n_groups", "dp_diff", "eo_diff", "protected_attr", "alert"))


@register("ema_stream_shuffled", "FAIR-14 (late steps)", _BATCH + f", {_SUMMARY} " + f"""
SELECT a.batch, round(a.max_dp_diff, 6) AS max_dp_diff, round(a.max_eo_diff, 6) AS max_eo_diff,
       {_ema_sql('max_dp_diff')}, {_ema_sql('max_eo_diff')}
FROM summary a JOIN summary b ON b.batch <= a.batch
GROUP BY a.batch, a.max_dp_diff, a.max_eo_diff
""")
def q_ema_stream_shuffled(spark, sf):
    """Every step an hour of event time; steps arrive in the order of a draw, and a last row of another run moves time on."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("late-src", "late-sink", "late-ckpt"))
    summary = fz.batch_summary(fz.fairness_report(replay(spark, sf), protected=ORDERS_PROTECTED, keys=["batch"])).drop("alert")
    rows = materialize(summary.select(F.lit("run-1").alias("run_id"), "batch", "max_dp_diff", "max_eo_diff",
                                      F.timestamp_seconds(F.col("batch") * 3600).alias("ts")))
    for k in range(N_STEPS):  # any order
        rows.where(F.pmod(F.xxhash64("batch"), F.lit(N_STEPS)) == k).coalesce(1).write.mode("append").parquet(src)
    for k in range(2):  # the second is there for the micro-batch that sees the first one's time
        end = rows.groupBy().agg((F.max("batch") * 2 + 1000 + k).alias("batch")).select(
            F.lit("end").alias("run_id"), "batch", F.lit(0.0).alias("max_dp_diff"), F.lit(0.0).alias("max_eo_diff"),
            F.timestamp_seconds(F.col("batch") * 7200).alias("ts"))
        end.coalesce(1).write.mode("append").parquet(src)
    stream = SM.file_stream(spark, src, rows.schema)
    last = rows.agg(F.max("batch")).first()[0] or 0
    out = SM.ema_stream(stream, ["max_dp_diff", "max_eo_diff"], ["run_id"], step="batch", event_time="ts",
                        delay=f"{last + 1} hours")
    (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return finish(spark.read.parquet(sink).where("run_id = 'run-1'").drop("run_id", "ts"))


@register("ema_stream", "FAIR-14", _BATCH + f", {_SUMMARY} " + f"""
SELECT a.batch, round(a.max_dp_diff, 6) AS max_dp_diff, round(a.max_eo_diff, 6) AS max_eo_diff,
       {_ema_sql('max_dp_diff')}, {_ema_sql('max_eo_diff')}
FROM summary a JOIN summary b ON b.batch <= a.batch
GROUP BY a.batch, a.max_dp_diff, a.max_eo_diff
""")
def q_ema_stream(spark, sf):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("ema-src", "ema-sink", "ema-ckpt"))
    summary = fz.batch_summary(fz.fairness_report(replay(spark, sf), protected=ORDERS_PROTECTED,
                                                  keys=["batch"])).drop("alert")
    _feed(summary.withColumn("run_id", F.lit("run-1")), src, F.col("batch"), "run_id")  # a run is one series
    stream = SM.file_stream(spark, src, spark.read.parquet(src).schema)
    out = SM.ema_stream(stream, ["max_dp_diff", "max_eo_diff"], ["run_id"], step="batch").drop("run_id")
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return finish(spark.read.parquet(sink))


_WINDOW_SQL = S.fairness_ctes(
    f"SELECT *, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start FROM ({S.EVENTS_SCORED})",
    EVENTS_PROTECTED, keys=("window_start",))


@register("fairness_window", "FAIR-15", _WINDOW_SQL + f"SELECT window_start, {_REPORT_COLS} FROM report")
def q_fairness_window(spark, sf):
    ev = events_scored(spark, sf, cast_ts=False)
    return finish(SM.fairness_window(ev, "ts", "1 day", protected=EVENTS_PROTECTED))


def window_stream_counts(spark, sf, watermark: str = "1 day"):
    """Streaming form of FAIR-15 over events files; returns the sink's counts."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("win-src", "win-sink", "win-ckpt"))
    ev = events_scored(spark, sf, cast_ts=False)
    _feed(ev, src, F.unix_date(F.col("ts").cast("date")))
    stream = SM.file_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=64)
    counts = SM.windowed_confusion(stream, "ts", "1 day", fz.DEFAULT_TARGETS, EVENTS_PROTECTED, watermark)
    q = (counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


@register("fairness_window_stream", "FAIR-15", _WINDOW_SQL + f"""
SELECT window_start, {_REPORT_COLS} FROM report
WHERE window_start + 86400 <= (SELECT epoch(max(ts)) FROM events) - 86400
""")
def q_fairness_window_stream(spark, sf):
    return finish(SM.report_from_window_counts(window_stream_counts(spark, sf)))

