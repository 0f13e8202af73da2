"""Fairness monitoring on Structured Streaming sources.

* ``fairness_stream`` — the batch monitor, micro-batch by micro-batch:
  ``readStream`` (parquet/CSV files) → ``foreachBatch`` running the same
  ``fairness_report`` plan → parquet sink partitioned by ``(run_id, epoch_id)``.
  A replayed epoch overwrites its own partition (dynamic partition overwrite),
  so a restart from the checkpoint never duplicates rows.  An epoch's last write
  is its commit marker; ``read_committed`` shows epochs that have one, so that the
  sink's tables change together.  Row batches go on from epoch to epoch.
* ``ema_stream`` — smoothing that survives across micro-batches, one double
  (plus the last step) of state per series, via ``applyInPandasWithState``; with an
  event time, rows wait in the state until the watermark says that all before
  them are there.
* ``fairness_window_counts`` — event-time tumbling windows with a watermark;
  confusion counts per (window, target, attribute, group) in append mode.  Gaps
  for closed windows are computed from those counts in batch.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import fairness as fz
from ..operators.cleaning import epoch_seconds_of
from ..operators.sampling import assign_batches
from ..operators.smoothing import smooth_block
from ..sources.sinks import read_history


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("header", True).load(path))


def _write_epoch(df: DataFrame, sink: str, run_id: str, epoch_id: int) -> None:
    """Replace exactly this (run, epoch) partition — a replayed epoch never duplicates."""
    (df.withColumn("run_id", F.lit(run_id)).withColumn("epoch_id", F.lit(int(epoch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "epoch_id").parquet(sink))


COMMITS = "_commits"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def committed(spark: SparkSession, sink: str) -> DataFrame | None:
    """(rows, run_id, epoch_id) of the epochs that are complete; None if there is none yet."""
    return read_history(spark, sink + COMMITS, epoch_col="epoch_id") if _exists(spark, sink + COMMITS) else None


def read_committed(spark: SparkSession, sink: str, table: str = "", latest_by: Sequence[str] = ()) -> DataFrame:
    """The sink's table (``""``, ``_summary``, ``_worst``, ``_groups`` or ``_counts``) without epochs that are not complete.

    ``latest_by``: of each run and these columns only the rows of the last epoch, for
    batches that were reported again as more of their rows came.
    """
    done = committed(spark, sink)
    if done is None:
        return read_history(spark, sink + table, epoch_col="epoch_id").limit(0)
    rows = read_history(spark, sink + table, epoch_col="epoch_id").join(
        done.select("run_id", "epoch_id"), ["run_id", "epoch_id"], "left_semi")
    if not latest_by:
        return rows
    keys = ["run_id", *latest_by]
    return rows.join(rows.groupBy(*keys).agg(F.max("epoch_id").alias("epoch_id")), [*keys, "epoch_id"], "left_semi")


def fairness_stream(stream: DataFrame, sink: str, checkpoint: str, run_id: str,
                    targets: Sequence[fz.Target] = fz.DEFAULT_TARGETS, protected: Sequence[str] = (),
                    threshold: float = 0.10, keys: Sequence[str] = (),
                    available_now: bool = True, processing_time: str | None = None,
                    batch_size: int | None = None, order_by: Sequence[str] = (),
                    prepare: Callable[[DataFrame], DataFrame] | None = None, details: bool = False):
    """Start the monitor; returns the ``StreamingQuery``.

    ``run_id`` names the run whose epochs a restart from the same checkpoint
    replaces, so it has to be the same for both.
    ``keys`` are row columns to report by inside each micro-batch (e.g. a batch
    number carried by the rows); without keys each micro-batch is one report.
    ``batch_size`` (with a total ``order_by`` inside a micro-batch) slices the rows
    into batches of that size (distributed rank) that go on from epoch to epoch: the
    commit markers tell how many rows went before.  A batch that spans epochs is
    reported in each with all its rows so far, from the counts kept in ``<sink>_counts``;
    ``read_committed(..., latest_by=["batch"])`` shows the last report of each.
    ``prepare`` is applied to the rows first (e.g. score with models, then gate).
    ``details`` also writes ``<sink>_summary``, ``<sink>_worst`` and
    ``<sink>_groups``: per batch the largest gaps and the alert, the worst
    driver, and the per-group counts and rates.
    """
    if batch_size and not order_by:
        raise ValueError("row batches inside a micro-batch need an explicit order_by")

    def per_batch(batch_df: DataFrame, epoch_id: int) -> None:
        spark = batch_df.sparkSession
        report_keys = list(keys)
        data = prepare(batch_df) if prepare else batch_df
        n_rows = data.count()
        if batch_size:
            done = committed(spark, sink)
            before = 0 if done is None else done.where((F.col("run_id") == run_id) & (F.col("epoch_id") < epoch_id)).agg(
                F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            data = assign_batches(data, order_by, batch_size, before=before)
            report_keys.append("batch")
            counts = fz.confusion_by_group(data, targets, protected, report_keys)
            _write_epoch(counts, f"{sink}_counts", run_id, epoch_id)
            counts = read_history(spark, f"{sink}_counts", epoch_col="epoch_id").where(
                (F.col("run_id") == run_id) & (F.col("epoch_id") == epoch_id))
            if before % batch_size:  # the first batch has rows of epochs before
                open_ = before // batch_size + 1
                counts = counts.unionByName(read_committed(spark, sink, "_counts").where(
                    (F.col("run_id") == run_id) & (F.col("epoch_id") < epoch_id) & (F.col("batch") == open_)))
            sums = [F.sum(c).alias(c) for c in ("n", "tp", "tn", "fp", "fn")]
            whole = counts.groupBy(*report_keys, "target", "attribute", "grp").agg(*sums)
            groups = fz.group_rates(whole).persist()
        else:
            groups = fz.group_report(data, targets, protected, report_keys).persist()  # read by up to four writes
        try:
            report = fz.fairness_alert(fz.fairness_gaps(groups, report_keys), threshold)
            _write_epoch(report, sink, run_id, epoch_id)
            if details:
                _write_epoch(fz.batch_summary(report, report_keys), f"{sink}_summary", run_id, epoch_id)
                _write_epoch(fz.worst_driver(report, threshold, report_keys, [t.name for t in targets], protected),
                             f"{sink}_worst", run_id, epoch_id)
                _write_epoch(groups, f"{sink}_groups", run_id, epoch_id)
            _write_epoch(spark.createDataFrame([(n_rows,)], "rows long"), sink + COMMITS, run_id, epoch_id)  # the last one
        finally:
            groups.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


# ---------------------------------------------------------------------------
# FAIR-14: smoothing with state across micro-batches
# ---------------------------------------------------------------------------

def _smooth_arrivals(values: Sequence[str], step: str, alpha: float):
    def fn(key, pdfs, state):
        pdf = pd.concat(list(pdfs)).sort_values(step, kind="stable")
        last, *carry = state.get if state.exists else (None, *[None] * len(values))
        late = pdf[step] <= last if last is not None else pd.Series(False, index=pdf.index)
        fresh = pdf[~late]
        out = smooth_block(fresh[list(values)], alpha, carry).set_axis(fresh.index)
        smoothed = out.reindex(pdf.index).add_suffix("_smoothed")
        if len(fresh):
            state.update((int(fresh[step].iloc[-1]),
                          *(None if pd.isna(x) else float(x) for x in out.iloc[-1])))
        yield pd.concat([pdf, smoothed], axis=1)
    return fn


def _smooth_in_order(values: Sequence[str], step: str, alpha: float, event_time: str):
    """Rows wait in the state until the watermark has passed their event time, and are smoothed by step then."""
    def fn(key, pdfs, state):
        held, *carry = state.get if state.exists else (None, *[None] * len(values))
        parts = [pd.read_pickle(io.BytesIO(held))] if held else []
        parts += list(pdfs) if not state.hasTimedOut else []
        pdf = pd.concat([p for p in parts if len(p)]) if any(len(p) for p in parts) else None
        if pdf is None:
            return
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        due = pdf[event_time] <= mark
        ready, rest = pdf[due].sort_values(step, kind="stable"), pdf[~due]
        if len(ready):
            out = smooth_block(ready[list(values)].reset_index(drop=True), alpha, carry)
            carry = [None if pd.isna(x) else float(x) for x in out.iloc[-1]]
            smoothed = out.add_suffix("_smoothed").set_axis(ready.index)
            yield pd.concat([ready.reset_index(drop=True), smoothed.reset_index(drop=True)], axis=1)
        kept = io.BytesIO()
        if len(rest):
            rest.to_pickle(kept)
            state.setTimeoutTimestamp(int(rest[event_time].min().timestamp() * 1000) + 1)
        state.update((kept.getvalue() or None, *carry))
    return fn


def ema_stream(stream: DataFrame, values: Sequence[str], series: Sequence[str], step: str = "batch",
               alpha: float = 0.25, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Streaming EMA per series (columns that tell the series apart, e.g. the run).

    With ``event_time`` (a timestamp that grows with the step) rows may arrive in any
    order up to ``delay`` late: each waits in the state, one buffer per series of the
    rows within the delay, until the watermark has passed it, and is then smoothed in
    step order.  A row later than that is dropped by Spark.  Without it:

    Rows of one series must arrive in step order across micro-batches (inside a
    micro-batch they are sorted).  A row whose step isn't beyond the last one
    smoothed is late: it comes out with NULL smoothed values and changes no
    state.  State per series: the last step and the last smoothed value of every
    column; the work per group is the rows that arrive in one micro-batch.
    """
    if not series:
        raise ValueError("ema_stream needs the columns that tell series apart")
    out_fields = list(stream.schema.fields) + [T.StructField(f"{v}_smoothed", T.DoubleType()) for v in values]
    state_schema = T.StructType([T.StructField("last_step", T.LongType())]
                                + [T.StructField(f"s_{v}", T.DoubleType()) for v in values])
    if event_time is not None:
        held = T.StructType([T.StructField("held", T.BinaryType()), *state_schema.fields[1:]])
        return stream.withWatermark(event_time, delay).groupBy(*series).applyInPandasWithState(
            _smooth_in_order(values, step, alpha, event_time), T.StructType(out_fields), held,
            "append", GroupStateTimeout.EventTimeTimeout)
    return stream.groupBy(*series).applyInPandasWithState(
        _smooth_arrivals(values, step, alpha), T.StructType(out_fields), state_schema,
        "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------------------
# FAIR-15: event-time windows
# ---------------------------------------------------------------------------

def utc_instant(c, dtype: T.DataType):
    """``timestamp_ntz`` wall time read as UTC → ``timestamp`` (session-zone free)."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_micros((epoch_seconds_of(c, dtype) * F.lit(1000000)).cast("long"))
    return c.cast("timestamp")


def windowed_confusion(df: DataFrame, ts: str, window: str, targets: Sequence[fz.Target],
                       protected: Sequence[str], watermark: str | None = None,
                       null_label: str = "Unknown") -> DataFrame:
    """Confusion counts per (tumbling window, target, attribute, group).

    With ``watermark`` (streaming) rows later than the watermark are dropped by
    Spark and each window is emitted once, when it closes (append mode)."""
    t = utc_instant(F.col(ts), df.schema[ts].dataType)
    base = df.withColumn("_event_ts", t)
    if watermark:
        base = base.withWatermark("_event_ts", watermark)
    long = fz.long_form(base.withColumn("_win", F.window("_event_ts", window)), targets, protected,
                        keys=["_win"], null_label=null_label)
    y, p = F.col("y"), F.col("y_hat")
    return (long.groupBy("_win", "target", "attribute", "grp")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))
            .withColumn("window_start", F.unix_seconds(F.col("_win.start")))
            .drop("_win"))


def fairness_window(df: DataFrame, ts: str, window: str = "1 day",
                    targets: Sequence[fz.Target] = fz.DEFAULT_TARGETS, protected: Sequence[str] = (),
                    threshold: float = 0.10) -> DataFrame:
    """Batch form: gaps and alert per tumbling window (window start in epoch seconds)."""
    conf = windowed_confusion(df, ts, window, targets, protected)
    return fz.fairness_alert(fz.fairness_gaps(fz.group_rates(conf), ["window_start"]), threshold)


def report_from_window_counts(counts: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Gaps per closed window from the counts a streaming query appended."""
    return fz.fairness_alert(fz.fairness_gaps(fz.group_rates(counts), ["window_start"]), threshold)
