"""Registered evaluation queries (EVAL-1..2) on rule-based predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as fz
from ..operators import metrics as M
from ..sources.tables import table
from . import sqltext as S
from .registry import finish, register
from .views import orders_scored


def _metrics_sql() -> str:
    rate = S.rate
    return f"""
WITH s AS ({S.ORDERS_SCORED}),
l AS (SELECT 'RTS' AS target, rts_true AS y, rts_pred AS p FROM s UNION ALL
      SELECT 'RTP', rtp_true, rtp_pred FROM s),
c AS (SELECT target, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM l GROUP BY target)
SELECT target, n, round({rate('tp + tn', 'n')}, 6) AS accuracy, round({rate('tp', 'tp + fp')}, 6) AS precision,
       round({rate('tp', 'tp + fn')}, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM c
"""


@register("classification_metrics", "EVAL-1", _metrics_sql())
def q_classification_metrics(spark, sf):
    return finish(M.classification_metrics(orders_scored(spark, sf), fz.DEFAULT_TARGETS))


def _auc_sql(score: str) -> str:
    return f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST({score} AS DOUBLE) AS s FROM orders),
r AS (SELECT y, CAST(rank() OVER (ORDER BY s) AS DOUBLE)
              + CAST(count(*) OVER (PARTITION BY s) - 1 AS DOUBLE) / 2.0 AS ar FROM d WHERE s IS NOT NULL),
t AS (SELECT count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn,
             sum(CASE WHEN y = 1 THEN ar ELSE 0.0 END) AS rs FROM r)
SELECT CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg,
       round(CASE WHEN np > 0 AND nn > 0 THEN (rs - CAST(np AS DOUBLE) * (CAST(np AS DOUBLE) + 1.0) / 2.0)
             / (CAST(np AS DOUBLE) * CAST(nn AS DOUBLE)) END, 6) AS auc
FROM t
"""


def _auc_frame(spark, sf, score):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), score.alias("s"))


@register("roc_auc", "EVAL-2", _auc_sql("o_totalprice"))
def q_roc_auc(spark, sf):
    return finish(M.roc_auc(_auc_frame(spark, sf, F.col("o_totalprice")), "y", "s"))


@register("roc_auc_ties", "EVAL-2", _auc_sql("floor(o_totalprice / 50000)"))
def q_roc_auc_ties(spark, sf):
    return finish(M.roc_auc(_auc_frame(spark, sf, F.floor(F.col("o_totalprice") / 50000)), "y", "s"))
