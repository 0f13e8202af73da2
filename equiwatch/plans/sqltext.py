"""DuckDB-dialect SQL text for the oracle side of every registered query.

These strings are the *specification* the Spark plans are checked against; they
are only ever run by the external checker, never by the library.
"""

from __future__ import annotations

from collections.abc import Sequence


def i(cond: str) -> str:
    return f"COALESCE(CAST(({cond}) AS INTEGER), 0)"


def hash_draw(key: str, seed: int) -> str:
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")


ORDERS_SCORED = f"""
SELECT o.o_orderkey, o.o_orderdate,
       {i("o.o_orderstatus = 'F'")} AS rts_true,
       {i("o.o_totalprice >= 250000")} AS rts_pred,
       {i("o.o_orderpriority IN ('1-URGENT', '2-HIGH')")} AS rtp_true,
       {i("o.o_totalprice >= 250000")} * {i("c.c_acctbal >= 3000")} AS rtp_pred,
       c.c_mktsegment, r.r_name,
       CAST(year(o.o_orderdate) AS VARCHAR) AS order_year
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

DOCS_SCORED = f"""
SELECT d.doc_id,
       {i("l.quality = 1")} AS rts_true,
       {i("d.n_chars >= 500")} AS rts_pred,
       {i("l.toxic = 0")} AS rtp_true,
       {i("d.n_chars >= 500")} * {i("d.n_chars >= 1000")} AS rtp_pred,
       d.lang, d.source,
       CAST(((d.n_chars % 3) + 3) % 3 AS VARCHAR) AS n_chars_mod3
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

EVENTS_SCORED = f"""
SELECT event_id, ts,
       {i("event_type = 'purchase'")} AS rts_true,
       {i("value >= 35")} AS rts_pred,
       {i("event_type IN ('purchase', 'click')")} AS rtp_true,
       {i("value >= 35")} * {i("value <= 100")} AS rtp_pred,
       CAST(((user_id % 3) + 3) % 3 AS VARCHAR) AS user_mod3,
       CAST(((CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) + 5) % 5 AS VARCHAR) AS k_mod5
FROM events
"""

READINESS = f"""
SELECT l.l_orderkey, l.l_linenumber,
       o.o_totalprice / 5000 AS performance_score,
       l.l_quantity / 5 AS fatigue_score,
       CAST(l.l_linenumber - 1 AS BIGINT) AS recovery_days,
       l.l_discount * 1000 AS acl_risk_score,
       l.l_tax * 100 AS load_balance_score,
       CAST({i("l.l_returnflag = 'R'")} AS BIGINT) AS injury_indicator,
       l.l_extendedprice / 10000 AS team_contribution,
       o.o_orderpriority AS priority,
       o.o_orderstatus AS status,
       l.l_shipdate AS ship_ts
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

TARGETS = (("RTS", "rts_true", "rts_pred"), ("RTP", "rtp_true", "rtp_pred"))


def long_form(src: str, protected: Sequence[str], keys: Sequence[str] = (),
              targets=TARGETS, null_label: str = "Unknown") -> str:
    kk = "".join(f"{k}, " for k in keys)
    parts = []
    for name, y, p in targets:
        for a in protected:
            parts.append(
                f"SELECT {kk}'{name}' AS target, '{a}' AS attribute, "
                f"COALESCE(CAST({a} AS VARCHAR), '{null_label}') AS grp, "
                f"CAST({y} AS INTEGER) AS y, CAST({p} AS INTEGER) AS y_hat FROM {src}")
    return "\nUNION ALL\n".join(parts)


def confusion(long_src: str, keys: Sequence[str] = ()) -> str:
    kk = "".join(f"{k}, " for k in keys)
    return f"""
SELECT {kk}target, attribute, grp,
       count(*) AS n,
       count(*) FILTER (WHERE y = 1 AND y_hat = 1) AS tp,
       count(*) FILTER (WHERE y = 0 AND y_hat = 0) AS tn,
       count(*) FILTER (WHERE y = 0 AND y_hat = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND y_hat = 0) AS fn
FROM {long_src}
GROUP BY {kk}target, attribute, grp
"""


def rate(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END)"


def rates(conf_src: str) -> str:
    return f"""
SELECT *,
       {rate("tp + fp", "n")} AS selection_rate,
       {rate("tp", "tp + fn")} AS tpr,
       {rate("fp", "fp + tn")} AS fpr,
       {rate("tp + tn", "tp + tn + fp + fn")} AS accuracy
FROM {conf_src}
"""


def gaps(rates_src: str, keys: Sequence[str] = (), threshold: float = 0.10) -> str:
    kk = "".join(f"{k}, " for k in keys)
    return f"""
SELECT *, (dp_diff > {threshold!r} OR eo_diff > {threshold!r}) AS alert FROM (
SELECT {kk}target, attribute, count(*) AS n_groups,
       CASE WHEN count(*) >= 2 THEN max(selection_rate) - min(selection_rate) ELSE 0.0 END AS dp_diff,
       CASE WHEN count(*) >= 2 THEN greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) ELSE 0.0 END AS eo_diff,
       target || ':' || attribute AS protected_attr
FROM {rates_src}
GROUP BY {kk}target, attribute)
"""


def fairness_ctes(view_sql: str, protected: Sequence[str], keys: Sequence[str] = (),
                  threshold: float = 0.10, view_name: str = "scored") -> str:
    """CTE chain ending in ``conf``, ``rates`` and ``report``."""
    return f"""
WITH {view_name} AS ({view_sql}),
long AS ({long_form(view_name, protected, keys)}),
conf AS ({confusion("long", keys)}),
rates AS ({rates("conf")}),
report AS ({gaps("rates", keys, threshold)})
"""


def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


def row_key(*cols: str) -> str:
    return " || '-' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)


_KEY = row_key("l_orderkey", "l_linenumber")
_CENTS = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
_DOLLARS = f"({_CENTS} // 100)"
_MONEY = (f"'$' || (CASE WHEN {_DOLLARS} >= 1000 THEN CAST({_DOLLARS} // 1000 AS VARCHAR) || ',' || "
          f"lpad(CAST({_DOLLARS} % 1000 AS VARCHAR), 3, '0') ELSE CAST({_DOLLARS} AS VARCHAR) END)"
          f" || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0')")

DIRTY = f"""
SELECT {_KEY} AS row_key,
  CASE WHEN {hash_draw(_KEY, 11)} < 0.05 THEN NULL WHEN {hash_draw(_KEY, 11)} < 0.13 THEN 'x'
       WHEN {hash_draw(_KEY, 11)} < 0.15 THEN '12d' ELSE {_MONEY} END AS money,
  CASE WHEN {hash_draw(_KEY, 12)} < 0.05 THEN NULL WHEN {hash_draw(_KEY, 12)} < 0.15 THEN 'n/a'
       ELSE CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS pct,
  CASE WHEN {hash_draw(_KEY, 13)} < 0.05 THEN NULL WHEN {hash_draw(_KEY, 13)} < 0.15 THEN 'maybe'
       WHEN l_linestatus = 'O' THEN ' Yes' ELSE 'no ' END AS yn,
  CASE WHEN {hash_draw(_KEY, 14)} < 0.35 THEN 'about ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
       ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty_txt,
  l_returnflag AS flag,
  CASE WHEN {hash_draw(_KEY, 15)} < 0.02 THEN CAST('nan' AS DOUBLE) WHEN {hash_draw(_KEY, 15)} < 0.04
       THEN CAST('inf' AS DOUBLE) WHEN {hash_draw(_KEY, 15)} < 0.06 THEN CAST('-inf' AS DOUBLE)
       ELSE l_tax END AS ratio,
  l_quantity * 3 AS qty3,
  l_shipdate AS ship_ts
FROM lineitem
"""

# Spelled out here, not imported: an error in the code under test must show.
TRUTHY = ("1", "true", "t", "yes", "y", "ready", "cleared", "pass", "passed")
FALSY = ("0", "false", "f", "no", "n", "not ready", "uncleared", "fail", "failed")
NUMERIC_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_BLANK_CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                0x202F, 0x205F, 0x3000)
BLANKS = "'" + "".join(map(chr, _BLANK_CODES)) + "'"


def strip(t: str) -> str:
    return f"trim({t}, {BLANKS})"


def sql_list(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


def is_boolish(c: str) -> str:
    return f"COALESCE(lower({strip(f"CAST({c} AS VARCHAR)")}) IN ({sql_list(TRUTHY + FALSY)}), false)"


def boolish_value(c: str) -> str:
    low = f"lower({strip(f'CAST({c} AS VARCHAR)')})"
    return f"(CASE WHEN {low} IN ({sql_list(TRUTHY)}) THEN 1 WHEN {low} IN ({sql_list(FALSY)}) THEN 0 END)"


def parse_number(c: str) -> str:
    t = strip(f"translate(CAST({c} AS VARCHAR), '$,%', '')")
    return f"(CASE WHEN regexp_matches({t}, '{NUMERIC_PATTERN}') THEN TRY_CAST({t} AS DOUBLE) END)"
