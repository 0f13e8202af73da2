"""Classification metrics per target: accuracy, precision, recall, F1, ROC AUC.

``classification_metrics`` is one aggregate (four ``count_if`` per target, all
targets in one pass).  ``roc_auc`` is exact with tied scores averaged: rows
are first grouped by score (a hot score collapses map-side), running sums of
the counts along the distinct scores give each its average rank, and
AUC = (Σ_pos avg_rank − P(P+1)/2) / (P·N).  No row is ranked on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_rate
from .fairness import Target
from .ordering import running_sums


def classification_metrics(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """One row per target; precision/recall/F1 are 0 where undefined."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("target"), F.col(t.actual).cast("int").alias("y"),
                 F.col(t.predicted).cast("int").alias("p")) for t in targets])).alias("_t")).select("_t.*")
    y, p = F.col("y"), F.col("p")
    g = (long.groupBy("target")
         .agg(F.count(F.lit(1)).alias("n"),
              F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
              F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn")))
    prec = safe_rate(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return (g.withColumn("accuracy", safe_rate(F.col("tp") + F.col("tn"), F.col("n")))
             .withColumn("precision", prec).withColumn("recall", rec)
             .withColumn("f1", safe_rate(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")))
             .select("target", "n", "accuracy", "precision", "recall", "f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: n_pos, n_neg, auc (NULL with a single class)."""
    base = df.select(F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    base = base.where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    scores = base.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    ties = running_sums(scores, ["_s"], {"_upto": "_cnt"})
    avg_rank = F.col("_upto").cast("double") - (F.col("_cnt") - 1).cast("double") / F.lit(2.0)
    tot = ties.agg(F.sum(F.col("_pos")).alias("n_pos"), F.sum(F.col("_cnt") - F.col("_pos")).alias("n_neg"),
                   F.sum(F.col("_pos").cast("double") * avg_rank).alias("_rsum"))
    P, N = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 (F.col("_rsum") - P * (P + F.lit(1.0)) / F.lit(2.0)) / (P * N))
    return tot.select(F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      auc.alias("auc"))
