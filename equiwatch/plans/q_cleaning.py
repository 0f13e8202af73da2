"""Registered cleaning and expression queries (CLEAN-1..4, CLEAN-6, EXPR-1..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cleaning as CL
from . import sqltext as S
from .q_health import docs_labels
from .registry import finish, register
from .views import dirty, readiness


def _lazy_sql(cols) -> str:
    shares = ", ".join(
        f"avg(CASE WHEN {S.is_boolish(c)} THEN 1.0 ELSE 0.0 END) AS b{i}, "
        f"avg(CASE WHEN {S.parse_number(c)} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS n{i}"
        for i, c in enumerate(cols))
    outs = ", ".join(
        f"round(CASE WHEN s.b{i} > 0.6 THEN CAST({S.boolish_value('d.' + c)} AS DOUBLE) "
        f"WHEN s.n{i} >= 0.7 THEN {S.parse_number('d.' + c)} END, 6) AS {c}__num, "
        f"CASE WHEN s.b{i} <= 0.6 AND s.n{i} < 0.7 THEN d.{c} END AS {c}__text"
        for i, c in enumerate(cols))
    return f"WITH d AS ({S.DIRTY}), s AS (SELECT {shares} FROM d) SELECT d.row_key, {outs} FROM d, s"


_BOOL_COLS = ("yn", "flag")
_NUM_COLS = ("money", "pct", "qty_txt")


@register("coerce_boolish", "CLEAN-1", _lazy_sql(_BOOL_COLS))
def q_coerce_boolish(spark, sf):
    d = dirty(spark, sf).select("row_key", *_BOOL_COLS)
    return finish(CL.clean_lazy(d, list(_BOOL_COLS)))


@register("coerce_numeric", "CLEAN-2", _lazy_sql(_NUM_COLS))
def q_coerce_numeric(spark, sf):
    d = dirty(spark, sf).select("row_key", *_NUM_COLS)
    return finish(CL.clean_lazy(d, list(_NUM_COLS)))


@register("datetime_to_epoch", "CLEAN-3", f"""
WITH d AS ({S.DIRTY})
SELECT row_key, round(CAST(epoch_us(ship_ts) AS DOUBLE) / 1000000.0, 6) AS ship_ts FROM d
""")
def q_datetime_to_epoch(spark, sf):
    d = dirty(spark, sf).select("row_key", "ship_ts")
    return finish(CL.datetime_to_epoch(d))


def _label_sql(c: str) -> str:
    plain = S.strip(f"CAST(d.{c} AS VARCHAR)")
    number = f"(CASE WHEN regexp_matches({plain}, '{S.NUMERIC_PATTERN}') THEN TRY_CAST({plain} AS DOUBLE) END)"
    return (f"CAST(trunc(COALESCE(CASE WHEN (SELECT avg(CASE WHEN {S.is_boolish(c)} THEN 1.0 ELSE 0.0 END) FROM d) > 0.6 "
            f"THEN CAST({S.boolish_value('d.' + c)} AS DOUBLE) ELSE {number} END, 0.0)) AS INTEGER)")


@register("label_to_int", "CLEAN-4", f"""
WITH d AS ({S.DIRTY})
SELECT d.row_key, {_label_sql('yn')} AS yn_label, {_label_sql('qty_txt')} AS qty_label FROM d
""")
def q_label_to_int(spark, sf):
    d = dirty(spark, sf).select("row_key", "yn", "qty_txt")
    d = CL.label_to_int(d, "yn", "yn_label")
    d = CL.label_to_int(d, "qty_txt", "qty_label")
    return d.select("row_key", "yn_label", "qty_label")


@register("sanitize_nonfinite", "CLEAN-6", f"""
WITH d AS ({S.DIRTY})
SELECT row_key, round(CASE WHEN isnan(ratio) OR isinf(ratio) THEN 0.0 ELSE ratio END, 6) AS ratio FROM d
""")
def q_sanitize_nonfinite(spark, sf):
    d = dirty(spark, sf).select("row_key", "ratio")
    return finish(CL.sanitize(d, ["ratio"]))


def _bin_sql(c: str) -> str:
    edges, labels = C.AGE_EDGES, C.AGE_LABELS
    whens = []
    for k, lab in enumerate(labels):
        lo, hi = edges[k], edges[k + 1]
        op = ">=" if k == 0 else ">"
        whens.append(f"WHEN {c} {op} {lo} AND {c} <= {hi} THEN '{lab}'")
    return "CASE " + " ".join(whens) + " END"


@register("bin_column", "EXPR-1", f"""
WITH d AS ({S.DIRTY})
SELECT row_key, round(qty3, 6) AS qty3, {_bin_sql('qty3')} AS qty_bin FROM d
""")
def q_bin_column(spark, sf):
    d = dirty(spark, sf)
    return finish(d.select("row_key", "qty3", C.bin_column("qty3").alias("qty_bin")))


# A readiness score over the readiness view (weights of the generator's clearance
# formula, applied to the view's 0–10 style signals).
def _score_terms():
    """Built on call: Columns need an active session, the registry must import without one."""
    return (
        ("inv", F.col("acl_risk_score") / 10, 0.22, 10),
        ("inv", "fatigue_score", 0.18, 10),
        ("ratio", "recovery_days", 0.14, 30),
        ("raw", "load_balance_score", 0.12),
        ("inv", F.col("injury_indicator") * 10, 0.10, 10),
        ("in", "priority", -0.15, ("1-URGENT", "2-HIGH")),
        ("eq", "status", -0.08, "F"),
    )


_SCORE_THRESHOLD = 4.0
_SCORE_SQL = ("(((((((0.0 + (10.0 - CAST(acl_risk_score / 10 AS DOUBLE)) * CAST(0.22 AS DOUBLE))"
              " + (10.0 - CAST(fatigue_score AS DOUBLE)) * CAST(0.18 AS DOUBLE))"
              " + (CASE WHEN CAST(recovery_days AS DOUBLE) / 30.0 IS NOT NULL THEN"
              " least(greatest(CAST(recovery_days AS DOUBLE) / 30.0, 0.0), 1.0) END) * CAST(0.14 AS DOUBLE))"
              " + CAST(load_balance_score AS DOUBLE) * CAST(0.12 AS DOUBLE))"
              " + (10.0 - CAST(injury_indicator * 10 AS DOUBLE)) * CAST(0.1 AS DOUBLE))"
              " + (CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END) * CAST(-0.15 AS DOUBLE))"
              " + (CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END) * CAST(-0.08 AS DOUBLE))")


@register("linear_score_label", "EXPR-2", f"""
WITH r AS ({S.READINESS})
SELECT l_orderkey, l_linenumber, round({_SCORE_SQL}, 6) AS score,
       COALESCE(CAST({_SCORE_SQL} >= {_SCORE_THRESHOLD} AS INTEGER), 0) AS label
FROM r
""")
def q_linear_score_label(spark, sf):
    r = readiness(spark, sf)
    score = C.linear_score(_score_terms())
    return finish(r.select("l_orderkey", "l_linenumber", score.alias("score"),
                           C.threshold_label(score, _SCORE_THRESHOLD).alias("label")))


@register("clip", "EXPR-3", f"""
WITH r AS ({S.READINESS})
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN performance_score IS NOT NULL THEN least(greatest(performance_score, 25.0), 98.0) END, 6)
       AS performance_score
FROM r
""")
def q_clip(spark, sf):
    r = readiness(spark, sf)
    return finish(r.select("l_orderkey", "l_linenumber",
                           C.clip("performance_score", 25.0, 98.0).alias("performance_score")))


@register("null_group_label", "EXPR-4", """
SELECT d.doc_id, COALESCE(CAST(l.quality AS VARCHAR), 'Unknown') AS quality_group
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_null_group_label(spark, sf):
    d = docs_labels(spark, sf)
    return d.select("doc_id", C.null_group_label("quality").alias("quality_group"))
