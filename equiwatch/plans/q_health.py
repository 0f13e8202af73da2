"""Registered data-health queries (HEALTH-1..6, LIM-1)."""

from __future__ import annotations

from ..operators import health as H
from ..sources.tables import table
from .registry import finish, register

_DOCS_LABELS_SQL = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
_DOCS_LABELS_COLS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
_LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate")


def docs_labels(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels", parallel=False)
    return docs.join(labels, "doc_id", "left").select(*_DOCS_LABELS_COLS)


def _health_sql(src: str, cols, target: str | None) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    k = len(cols)
    if target:
        rate = (f"CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE TRY_CAST({target} AS BIGINT) IS NULL) = 0 "
                f"THEN CAST(sum(TRY_CAST({target} AS BIGINT)) AS DOUBLE) / count(*) * 100.0 END")
    else:
        rate = "CAST(NULL AS DOUBLE)"
    return f"""
WITH t AS ({src}),
d AS (SELECT count(*) AS groups FROM (SELECT DISTINCT * FROM t))
SELECT CAST(count(*) AS BIGINT) AS rows, CAST({k} AS INTEGER) AS cols,
       round(CASE WHEN count(*) > 0 THEN CAST({nulls} AS DOUBLE) / (CAST(count(*) AS DOUBLE) * {float(k)!r}) * 100.0
             ELSE 0.0 END, 6) AS missing_pct,
       round(CASE WHEN count(*) > 0 THEN CAST(count(*) - (SELECT groups FROM d) AS DOUBLE) / count(*) * 100.0
             ELSE 0.0 END, 6) AS dup_pct,
       round({rate}, 6) AS target_pos_rate
FROM t
"""


@register("dataset_health", "HEALTH-1", _health_sql(_DOCS_LABELS_SQL, _DOCS_LABELS_COLS, "toxic"))
def q_dataset_health(spark, sf):
    return finish(H.dataset_health(docs_labels(spark, sf), target="toxic"))


@register("dataset_health_labels", "HEALTH-1", _health_sql("SELECT * FROM labels", ("doc_id", "quality", "toxic"), "toxic"))
def q_dataset_health_labels(spark, sf):
    return finish(H.dataset_health(table(spark, sf, "labels"), target="toxic"))


@register("dataset_health_lineitem", "HEALTH-1", _health_sql("SELECT * FROM lineitem", _LINEITEM_COLS, None))
def q_dataset_health_lineitem(spark, sf):
    return finish(H.dataset_health(table(spark, sf, "lineitem")))


@register("missing_pct", "HEALTH-2", f"""
WITH t AS ({_DOCS_LABELS_SQL})
SELECT round(CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _DOCS_LABELS_COLS)} AS DOUBLE)
             / (CAST(count(*) AS DOUBLE) * 7.0) * 100.0, 6) AS missing_pct FROM t
""")
def q_missing_pct(spark, sf):
    return finish(H.missing_pct(docs_labels(spark, sf)))


@register("dup_pct", "HEALTH-3", """
WITH t AS (SELECT text, lang FROM documents)
SELECT round(CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS DOUBLE) / count(*) * 100.0, 6)
       AS dup_pct FROM t
""")
def q_dup_pct(spark, sf):
    return finish(H.dup_pct(table(spark, sf, "documents").select("text", "lang")))


@register("target_pos_rate", "HEALTH-4", """
SELECT round(CASE WHEN count(*) FILTER (WHERE TRY_CAST(quality AS BIGINT) IS NULL) = 0
             THEN CAST(sum(quality) AS DOUBLE) / count(*) * 100.0 END, 6) AS target_pos_rate FROM labels
""")
def q_target_pos_rate(spark, sf):
    return finish(H.target_pos_rate(table(spark, sf, "labels"), "quality"))


@register("health_bands", "HEALTH-5", f"""
WITH h AS ({_health_sql(_DOCS_LABELS_SQL, _DOCS_LABELS_COLS, "toxic")})
SELECT *,
  CASE WHEN missing_pct < 5 THEN 'good' WHEN missing_pct < 15 THEN 'warn' ELSE 'bad' END AS missing_mood,
  CASE WHEN dup_pct < 1 THEN 'good' WHEN dup_pct < 5 THEN 'warn' ELSE 'bad' END AS dup_mood,
  CASE WHEN target_pos_rate IS NULL THEN 'warn' WHEN target_pos_rate >= 25 AND target_pos_rate <= 75 THEN 'good'
       ELSE 'warn' END AS balance_mood
FROM h
""")
def q_health_bands(spark, sf):
    return H.health_bands(finish(H.dataset_health(docs_labels(spark, sf), target="toxic")))


@register("missing_by_column", "HEALTH-6", f"""
WITH t AS ({_DOCS_LABELS_SQL})
{" UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM t"
                    for c in _DOCS_LABELS_COLS)}
""")
def q_missing_by_column(spark, sf):
    return H.missing_by_column(docs_labels(spark, sf))


@register("preview", "LIM-1", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def q_preview(spark, sf):
    return H.preview(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 50)
