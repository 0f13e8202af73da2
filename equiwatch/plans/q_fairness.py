"""Registered fairness queries (FAIR-1..5) over the scored views."""

from __future__ import annotations

from ..operators import fairness as fz
from . import sqltext as S
from .registry import finish, register
from .views import (DOCS_PROTECTED, EVENTS_PROTECTED, ORDERS_PROTECTED, docs_scored,
                    events_scored, orders_scored)

_ORDERS = S.fairness_ctes(S.ORDERS_SCORED, ORDERS_PROTECTED)
_DOCS = S.fairness_ctes(S.DOCS_SCORED, DOCS_PROTECTED)
_EVENTS = S.fairness_ctes(S.EVENTS_SCORED, EVENTS_PROTECTED)
_ORDERS_05 = S.fairness_ctes(S.ORDERS_SCORED, ORDERS_PROTECTED, threshold=0.05)

_REPORT_COLS = "target, attribute, n_groups, round(dp_diff, 6) AS dp_diff, " \
               "round(eo_diff, 6) AS eo_diff, protected_attr, alert"


@register("confusion_by_group", "FAIR-1",
          _ORDERS + "SELECT target, attribute, grp, n, tp, tn, fp, fn FROM conf")
def q_confusion_by_group(spark, sf):
    return fz.confusion_by_group(orders_scored(spark, sf), protected=ORDERS_PROTECTED)


@register("group_rates", "FAIR-2",
          _DOCS + "SELECT target, attribute, grp, n, tp, tn, fp, fn, "
          + ", ".join(S.r6(c) for c in ("selection_rate", "tpr", "fpr", "accuracy")) + " FROM rates")
def q_group_rates(spark, sf):
    return finish(fz.group_report(docs_scored(spark, sf), protected=DOCS_PROTECTED))


@register("fairness_gaps", "FAIR-3",
          _EVENTS + "SELECT target, attribute, n_groups, round(dp_diff, 6) AS dp_diff, "
          "round(eo_diff, 6) AS eo_diff, protected_attr FROM report")
def q_fairness_gaps(spark, sf):
    conf = fz.confusion_by_group(events_scored(spark, sf), protected=EVENTS_PROTECTED)
    return finish(fz.fairness_gaps(fz.group_rates(conf)))


@register("fairness_alert", "FAIR-4", _ORDERS_05 + f"SELECT {_REPORT_COLS} FROM report")
def q_fairness_alert(spark, sf):
    rep = fz.fairness_report(orders_scored(spark, sf), protected=ORDERS_PROTECTED, threshold=0.05)
    return finish(rep)


@register("fairness_report", "FAIR-5", _ORDERS + f"SELECT {_REPORT_COLS} FROM report")
def q_fairness_report(spark, sf):
    rep = fz.fairness_report(orders_scored(spark, sf), protected=ORDERS_PROTECTED, threshold=0.10)
    return finish(rep)


@register("fairness_report_docs", "FAIR-5", _DOCS + f"SELECT {_REPORT_COLS} FROM report")
def q_fairness_report_docs(spark, sf):
    rep = fz.fairness_report(docs_scored(spark, sf), protected=DOCS_PROTECTED, threshold=0.10)
    return finish(rep)


# ---------------------------------------------------------------------------
# Replay in batches (FAIR-6..12): 35% of the scored orders (keyed draw, seed 7)
# in draw order, sliced into batches of 100 rows.
# ---------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..operators import sampling as SM  # noqa: E402
from ..operators.smoothing import ema  # noqa: E402

BATCH_SIZE = 100
LARGE_BATCH_SIZE = 10_000


def replay_sql(batch_size: int = BATCH_SIZE) -> str:
    return f"""
SELECT *, CAST((row_number() OVER (ORDER BY draw, o_orderkey) - 1) // {batch_size} + 1 AS BIGINT) AS batch
FROM (SELECT * FROM (SELECT *, {S.hash_draw('o_orderkey', 7)} AS draw FROM ({S.ORDERS_SCORED})) WHERE draw < 0.35)
"""


REPLAY_SQL = replay_sql()
_BATCH = S.fairness_ctes(REPLAY_SQL, ORDERS_PROTECTED, keys=("batch",))


def replay(spark, sf, batch_size: int = BATCH_SIZE):
    s = orders_scored(spark, sf)
    d = SM.sample_fraction(s, "o_orderkey", 0.35, 7)
    return SM.assign_batches(d, ["draw", "o_orderkey"], batch_size)


def _batch_report(spark, sf, threshold: float = 0.10, batch_size: int = BATCH_SIZE):
    return fz.fairness_report(replay(spark, sf, batch_size), protected=ORDERS_PROTECTED, threshold=threshold,
                              keys=["batch"])


@register("fairness_by_batch", "FAIR-6", _BATCH + f"SELECT batch, {_REPORT_COLS} FROM report")
def q_fairness_by_batch(spark, sf):
    return finish(_batch_report(spark, sf))


@register("fairness_by_batch_large", "FAIR-6",
          S.fairness_ctes(replay_sql(LARGE_BATCH_SIZE), ORDERS_PROTECTED, keys=("batch",))
          + f"SELECT batch, {_REPORT_COLS} FROM report")
def q_fairness_by_batch_large(spark, sf):
    return finish(_batch_report(spark, sf, batch_size=LARGE_BATCH_SIZE))


_SUMMARY = ("summary AS (SELECT batch, COALESCE(max(dp_diff), 0.0) AS max_dp_diff, "
            "COALESCE(max(eo_diff), 0.0) AS max_eo_diff, COALESCE(bool_or(alert), false) AS alert "
            "FROM report GROUP BY batch)")


@register("batch_summary", "FAIR-7", _BATCH + f", {_SUMMARY} "
          "SELECT batch, round(max_dp_diff, 6) AS max_dp_diff, round(max_eo_diff, 6) AS max_eo_diff, alert FROM summary")
def q_batch_summary(spark, sf):
    return finish(fz.batch_summary(_batch_report(spark, sf)))


_WORST = f"""
, ranked AS (SELECT *, greatest(dp_diff, eo_diff) AS severity,
    row_number() OVER (PARTITION BY batch ORDER BY greatest(dp_diff, eo_diff) DESC,
                       CASE target WHEN 'RTS' THEN 1 WHEN 'RTP' THEN 2 ELSE 3 END,
                       CASE attribute {" ".join(f"WHEN '{a}' THEN {i + 1}" for i, a in enumerate(ORDERS_PROTECTED))}
                       ELSE 99 END, attribute) AS rk
  FROM report)
"""


@register("worst_driver", "FAIR-8", _BATCH + _WORST + """
SELECT batch, protected_attr, round(dp_diff, 6) AS dp_diff, round(eo_diff, 6) AS eo_diff, round(severity, 6) AS severity,
       CASE WHEN dp_diff >= eo_diff THEN 'Demographic Parity' ELSE 'Equalized Odds' END AS driver,
       severity <= 0.1 AS stable
FROM ranked WHERE rk = 1
""")
def q_worst_driver(spark, sf):
    w = fz.worst_driver(_batch_report(spark, sf), 0.10, ["batch"], attribute_order=ORDERS_PROTECTED)
    return finish(w.drop("message"))


def _ema_sql(v: str) -> str:
    return (f"round(sum(CASE WHEN b.batch = 1 THEN b.{v} ELSE CAST(0.25 AS DOUBLE) * b.{v} END"
            f" * pow(CAST(0.75 AS DOUBLE), CAST(a.batch - b.batch AS DOUBLE))), 6) AS {v}_smoothed")


@register("ema_smooth", "FAIR-9", _BATCH + f", {_SUMMARY} " + f"""
SELECT a.batch, round(a.max_dp_diff, 6) AS max_dp_diff, round(a.max_eo_diff, 6) AS max_eo_diff,
       {_ema_sql('max_dp_diff')}, {_ema_sql('max_eo_diff')}
FROM summary a JOIN summary b ON b.batch <= a.batch
GROUP BY a.batch, a.max_dp_diff, a.max_eo_diff
""")
def q_ema_smooth(spark, sf):
    summ = fz.batch_summary(_batch_report(spark, sf)).drop("alert")
    return finish(ema(summ, ["max_dp_diff", "max_eo_diff"], step="batch", alpha=0.25))


@register("severity_bands", "FAIR-10", _BATCH + """
, sev AS (SELECT batch, protected_attr, greatest(dp_diff, eo_diff) AS severity FROM report)
SELECT batch, protected_attr, round(severity, 6) AS severity,
       CASE WHEN severity > 0.1 THEN 'bad' WHEN severity > 0.1 * 0.7 THEN 'warn' ELSE 'good' END AS mood,
       round(least(severity / 0.1, 1.0) * 100.0, 6) AS severity_pct,
       CASE WHEN severity <= 0.1 THEN 'OK' ELSE 'ALERT' END AS status
FROM sev
""")
def q_severity_bands(spark, sf):
    rep = _batch_report(spark, sf)
    sev = rep.select("batch", "protected_attr", F.greatest("dp_diff", "eo_diff").alias("severity"))
    return finish(fz.severity_bands(sev, 0.10))


def _r3(x: str) -> str:
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)"


@register("attr_summary", "FAIR-11", _BATCH + f"""
SELECT batch, protected_attr, {_r3('dp_diff')} AS dp, {_r3('eo_diff')} AS eo,
       {_r3('greatest(dp_diff, eo_diff)')} AS severity,
       CASE WHEN greatest(dp_diff, eo_diff) <= 0.1 THEN 'OK' ELSE 'ALERT' END AS status
FROM report
""")
def q_attr_summary(spark, sf):
    return fz.attr_summary(_batch_report(spark, sf), 0.10, ["batch"])


@register("group_breakdown", "FAIR-12", _BATCH + """
SELECT batch, target, attribute, grp, n, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr,
       round(fpr, 6) AS fpr, round(accuracy, 6) AS accuracy
FROM rates WHERE batch = (SELECT max(batch) FROM rates)
""")
def q_group_breakdown(spark, sf):
    rows = replay(spark, sf)   # ranked and checkpointed: the last batch is a filter
    rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return finish(fz.group_report(rows, protected=ORDERS_PROTECTED, keys=["batch"]).drop("tp", "tn", "fp", "fn"))


@register("protected_group_counts", "FILT-1", _ORDERS + """
SELECT attribute, count(DISTINCT grp) AS n_groups, count(DISTINCT grp) > 5 AS too_many FROM conf GROUP BY attribute
""")
def q_protected_group_counts(spark, sf):
    rates = fz.group_report(orders_scored(spark, sf), protected=ORDERS_PROTECTED)
    return fz.group_counts(rates, limit=5)
