"""Sinks for monitoring history: CSV export and an idempotent append table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_EXPORT_COLS = ("batch", "max_dp_diff", "max_eo_diff", "alert")


def history_projection(summary: DataFrame) -> DataFrame:
    return summary.select(*HISTORY_EXPORT_COLS)


def export_history_csv(summary: DataFrame, path: str) -> DataFrame:
    """Write ``batch,max_dp_diff,max_eo_diff,alert`` as CSV with a header (one file
    per task, no index column).  Returns the projection that was written."""
    proj = history_projection(summary)
    proj.write.mode("overwrite").option("header", True).csv(path)
    return proj


def append_history(summary: DataFrame, path: str, run_id: str, epoch_col: str = "epoch",
                   epoch: int | None = None) -> None:
    """Append rows to a parquet table partitioned by ``(run_id, epoch_col)``.

    The write replaces exactly the ``(run_id, epoch)`` partitions present in
    this frame (dynamic partition overwrite), so re-running an epoch after a
    failure replaces its rows instead of duplicating them, and other epochs and
    runs are untouched.  An epoch is coarse (a micro-batch, a day's replay): it
    becomes a folder.  ``epoch`` gives all rows of the frame that epoch.
    """
    rows = summary.withColumn("run_id", F.lit(run_id))
    if epoch is not None:
        rows = rows.withColumn(epoch_col, F.lit(int(epoch)).cast("long"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", epoch_col).parquet(path))


def read_history(spark, path: str, schema: T.StructType | None = None, epoch_col: str = "epoch") -> DataFrame:
    """The table with ``run_id`` as text and the epoch as a long, whatever they look like in folder names."""
    found = schema or spark.read.parquet(path).schema
    kinds = {"run_id": T.StringType(), epoch_col: T.LongType()}
    typed = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found.fields])
    return spark.read.schema(typed).parquet(path)
