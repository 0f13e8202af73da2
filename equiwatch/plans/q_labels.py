"""Registered label queries (LAB-1..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources.tables import table
from . import sqltext as S
from .registry import finish, register
from .views import orders_scored, readiness, row_key

_KEY_COLS = ("l_orderkey", "l_linenumber")
_R = f"WITH r AS ({S.READINESS})\n"


def _key():
    return row_key(*_KEY_COLS)


def _alias_view(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0")
         .otherwise("n/a").alias("RTS"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "1.0")
         .when(F.col("o_orderpriority") == "5-LOW", "x").otherwise("0").alias("return_to_performance"))


def _num_sql(c: str) -> str:
    t = S.strip(f"CAST({c} AS VARCHAR)")
    return (f"CAST(trunc(COALESCE(CASE WHEN regexp_matches({t}, '{S.NUMERIC_PATTERN}') "
            f"THEN TRY_CAST({t} AS DOUBLE) END, 0.0)) AS INTEGER)")


@register("label_alias", "LAB-1", f"""
WITH a AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN '0' ELSE 'n/a' END AS a_rts,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1.0' WHEN o_orderpriority = '5-LOW' THEN 'x'
              ELSE '0' END AS a_rtp
  FROM orders)
SELECT o_orderkey, {_num_sql('a_rts')} AS rts, {_num_sql('a_rtp')} AS rtp FROM a
""")
def q_label_alias(spark, sf):
    return L.label_alias(_alias_view(spark, sf))


_INJ_COND = ("COALESCE(COALESCE(CAST(injury_indicator AS DOUBLE), 1.0) = 0 AND acl_risk_score <= 55 "
             "AND fatigue_score <= 5 AND recovery_days >= 1, false)")
_NOINJ_COND = "COALESCE(acl_risk_score <= 55 AND fatigue_score <= 5 AND recovery_days >= 1, false)"


@register("rts_rule_injury", "LAB-2", _R + f"SELECT l_orderkey, l_linenumber, CAST({_INJ_COND} AS INTEGER) AS rts FROM r")
def q_rts_rule_injury(spark, sf):
    return L.rts_rule_injury(readiness(spark, sf)).select(*_KEY_COLS, "rts")


@register("rts_rule_no_injury", "LAB-3",
          _R + f"SELECT l_orderkey, l_linenumber, CAST({_NOINJ_COND} AS INTEGER) AS rts FROM r")
def q_rts_rule_no_injury(spark, sf):
    r = readiness(spark, sf).drop("injury_indicator")
    return L.rts_rule_no_injury(r).select(*_KEY_COLS, "rts")


@register("rts_rule_percentile", "LAB-4", _R + """
, q AS (SELECT quantile_cont(performance_score, 0.55) AS p FROM r)
SELECT l_orderkey, l_linenumber, CAST(COALESCE(performance_score >= q.p, false) AS INTEGER) AS rts FROM r, q
""")
def q_rts_rule_percentile(spark, sf):
    r = readiness(spark, sf).select(*_KEY_COLS, "performance_score")
    return L.rts_rule_percentile(r).select(*_KEY_COLS, "rts")


_RTP_Q = """
, q AS (SELECT quantile_cont(performance_score, 0.35) AS pp, quantile_cont(load_balance_score, 0.35) AS pb,
               quantile_cont(team_contribution, 0.35) AS pt, quantile_cont(fatigue_score, 0.8) AS pf FROM r)
"""
_RTP_COND = ("COALESCE(performance_score >= q.pp AND load_balance_score >= q.pb AND team_contribution >= q.pt "
             "AND fatigue_score <= q.pf, false)")


@register("rtp_rule_percentile", "LAB-5",
          _R + _RTP_Q + f"SELECT l_orderkey, l_linenumber, CAST({_RTP_COND} AS INTEGER) AS rtp FROM r, q")
def q_rtp_rule_percentile(spark, sf):
    return L.rtp_rule_percentile(readiness(spark, sf)).select(*_KEY_COLS, "rtp")


_KEY_SQL = S.row_key("l_orderkey", "l_linenumber")


_THIN_COND = "COALESCE(acl_risk <= 55 AND tired_level <= 5 AND recovery_days >= 1, false)"


@register("rtp_rule_thinned", "LAB-6", _R + f"""
, t AS (SELECT l_orderkey, l_linenumber, recovery_days, fatigue_score AS tired_level, acl_risk_score AS acl_risk
        FROM r)
SELECT l_orderkey, l_linenumber, CAST({_THIN_COND} AS INTEGER) AS rts,
       CAST(COALESCE({_THIN_COND} AND {S.hash_draw(_KEY_SQL, 42)} > 0.3, false) AS INTEGER) AS rtp
FROM t
""")
def q_rtp_rule_thinned(spark, sf):
    # No performance-like name (nothing matching "score"/"rating"/...), no injury
    # column: RTS by the three-signal rule, RTP = RTS thinned by the keyed draw.
    r = readiness(spark, sf).select(*_KEY_COLS, "recovery_days", F.col("fatigue_score").alias("tired_level"),
                                    F.col("acl_risk_score").alias("acl_risk"))
    out = L.derive_labels(r, _key())
    return out.select(*_KEY_COLS, "rts", "rtp")


@register("label_gate", "LAB-7", f"""
WITH s AS ({S.ORDERS_SCORED})
SELECT o_orderkey, rts_true, CAST(CASE WHEN rts_true = 0 THEN 0 ELSE rtp_true END AS INTEGER) AS rtp_true FROM s
""")
def q_label_gate(spark, sf):
    s = orders_scored(spark, sf).select("o_orderkey", "rts_true", "rtp_true")
    return L.label_gate(s, "rts_true", "rtp_true")


@register("derive_labels", "LAB-2/5/7", _R + _RTP_Q + f"""
SELECT l_orderkey, l_linenumber, CAST({_INJ_COND} AS INTEGER) AS rts,
       CAST(CASE WHEN CAST({_INJ_COND} AS INTEGER) = 0 THEN 0 ELSE CAST({_RTP_COND} AS INTEGER) END AS INTEGER) AS rtp
FROM r, q
""")
def q_derive_labels(spark, sf):
    return L.derive_labels(readiness(spark, sf), _key()).select(*_KEY_COLS, "rts", "rtp")


def _minmax_sql(x: str, name: str) -> tuple[str, str]:
    bounds = f"quantile_cont({x}, 0.05) AS lo_{name}, quantile_cont({x}, 0.95) AS hi_{name}"
    expr = (f"(CASE WHEN lo_{name} IS NOT NULL AND hi_{name} IS NOT NULL AND hi_{name} > lo_{name} THEN "
            f"(CASE WHEN ({x} - lo_{name}) / (hi_{name} - lo_{name}) IS NOT NULL THEN "
            f"least(greatest(({x} - lo_{name}) / (hi_{name} - lo_{name}), 0.0), 1.0) END) END)")
    return bounds, expr


_TB, _TE = _minmax_sql("team_contribution", "t")


@register("robust_minmax", "LAB-8", _R + f"""
, b AS (SELECT {_TB} FROM r)
SELECT l_orderkey, l_linenumber, round({_TE}, 6) AS team_contribution_norm FROM r, b
""")
def q_robust_minmax(spark, sf):
    r = readiness(spark, sf).select(*_KEY_COLS, "team_contribution")
    return finish(L.robust_minmax(r, "team_contribution").select(*_KEY_COLS, "team_contribution_norm"))


_PARTS = (("load_balance_score", "balance", False), ("performance_score", "perf", False),
          ("recovery_days", "recovery", True), ("acl_risk_score", "risk", True))


def _composite_sql() -> str:
    bounds, parts = [], []
    for col, name, inv in _PARTS:
        b, e = _minmax_sql(f"CAST({col} AS DOUBLE)", name)
        bounds.append(b)
        parts.append(f"(1.0 - {e})" if inv else e)
    total = "0.0"
    count = "0"
    for p in parts:
        total = f"({total} + COALESCE({p}, 0.0))"
        count = f"({count} + CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END)"
    score = f"CASE WHEN {count} > 0 THEN {total} / {count} END"
    return _R + f"""
, b AS (SELECT {", ".join(bounds)} FROM r)
, s AS (SELECT r.*, {score} AS score FROM r, b)
, q AS (SELECT quantile_cont(score, 0.55) AS q1, quantile_cont(score, 0.75) AS q2 FROM s)
SELECT l_orderkey, l_linenumber, CAST(COALESCE(score >= q1, false) AS INTEGER) AS rts,
       CAST(COALESCE(score >= q2, false) AS INTEGER) AS rtp, round(score, 6) AS readiness_score
FROM s, q
"""


@register("composite_label", "LAB-9", _composite_sql())
def q_composite_label(spark, sf):
    r = readiness(spark, sf).drop("team_contribution", "injury_indicator", "fatigue_score")
    out = L.composite_label(r, _key())
    return finish(out.select(*_KEY_COLS, "rts", "rtp", "readiness_score"))


def _fallback_sql() -> str:
    parts = ["CAST(o_orderkey AS DOUBLE)", "CAST(o_custkey AS DOUBLE)", "CAST(o_totalprice AS DOUBLE)",
             "CAST(epoch_us(o_orderdate) AS DOUBLE) / 1000000.0"]
    total, count = "0.0", "0"
    for p in parts:
        total = f"({total} + COALESCE({p}, 0.0))"
        count = f"({count} + CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END)"
    return f"""
WITH s AS (SELECT o_orderkey, CASE WHEN {count} > 0 THEN {total} / {count} END AS score FROM orders),
q AS (SELECT quantile_cont(score, 0.55) AS q1, quantile_cont(score, 0.75) AS q2 FROM s)
SELECT o_orderkey, CAST(COALESCE(score >= q1, false) AS INTEGER) AS rts,
       CAST(COALESCE(score >= q2, false) AS INTEGER) AS rtp, round(score, 6) AS readiness_score
FROM s, q
"""


@register("composite_label_fallback", "LAB-10", _fallback_sql())
def q_composite_label_fallback(spark, sf):
    o = table(spark, sf, "orders")
    out = L.composite_label(o, "o_orderkey")
    return finish(out.select("o_orderkey", "rts", "rtp", "readiness_score"))


@register("label_distribution", "LAB-11", _R + _RTP_Q + f"""
, l AS (SELECT CAST(CASE WHEN CAST({_INJ_COND} AS INTEGER) = 0 THEN 0 ELSE CAST({_RTP_COND} AS INTEGER) END
                    AS INTEGER) AS rtp FROM r, q)
SELECT rtp AS value, count(*) AS count FROM l GROUP BY rtp
""")
def q_label_distribution(spark, sf):
    labels = L.derive_labels(readiness(spark, sf), _key())
    return L.label_distribution(labels, "rtp")
