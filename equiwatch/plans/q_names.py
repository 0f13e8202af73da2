"""Registered column-discovery queries (NAME-1..3, FILT-1, CLEAN-5, HEALTH-7).

Names are resolved on the schema; every query then counts over the columns it
found, so what it reports is read from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as CL
from ..operators import fairness as fz
from ..operators import health as H
from ..operators import names as N
from ..sources.tables import table
from . import sqltext as S
from .registry import register
from .views import orders_scored, readiness


def _present(df, found: dict):
    """(name, column, present): non-missing cells of each column found (NULL column: not found)."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(c).cast("string").alias("column_name"),
                              F.col(f"n{i}").alias("present")) for i, (k, c) in enumerate(found.items())])
    counts = [(F.count(F.col(f"`{c}`")) if c else F.lit(None).cast("long")).alias(f"n{i}")
              for i, c in enumerate(found.values())]
    return df.agg(*counts).select(F.inline(rows))


def _present_sql(found: dict, source: str) -> str:
    """The expected columns, written out by hand, and their counts."""
    parts = [f"SELECT '{k}' AS name, " + (f"'{c}' AS column_name, (SELECT count({c}) FROM r) AS present" if c else
                                          "CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS BIGINT) AS present")
             for k, c in found.items()]
    return f"WITH r AS ({source}) " + " UNION ALL ".join(parts)


_ROLES = {"performance": "performance_score", "fatigue": "fatigue_score", "recovery": "recovery_days",
          "risk": "acl_risk_score", "balance": "load_balance_score", "team": "team_contribution",
          "injury": "injury_indicator"}
_PARTS = {"strength": None, "balance": "load_balance_score", "perf": "performance_score", "recovery": "recovery_days",
          "risk": "acl_risk_score"}


@register("name_roles", "NAME-1", _present_sql(_ROLES, S.READINESS))
def q_name_roles(spark, sf):
    r = readiness(spark, sf)
    return _present(r, vars(N.discover_roles(r.columns)))


@register("name_parts", "NAME-2", _present_sql(_PARTS, S.READINESS))
def q_name_parts(spark, sf):
    r = readiness(spark, sf)
    return _present(r, N.discover_parts(r.columns))


@register("default_mapping", "NAME-3", _present_sql(
    {"rts_target": "rts", "rtp_target": "rtp", "drop_0": "performance_score", "drop_1": "load_balance_score",
     "drop_2": "fatigue_score"},
    f"SELECT *, 1 AS rts, 0 AS rtp FROM ({S.READINESS})"))
def q_default_mapping(spark, sf):
    r = readiness(spark, sf).withColumns({"rts": F.lit(1), "rtp": F.lit(0)})
    m = N.default_mapping(r.columns)
    wanted = sorted(m.drop, key=N.DEFAULT_DROP.index)
    return _present(r, {"rts_target": m.rts_target, "rtp_target": m.rtp_target}
                    | {f"protected_{i}": c for i, c in enumerate(m.protected)}
                    | {f"drop_{i}": c for i, c in enumerate(wanted)})


@register("protected_present", "FILT-1", """
SELECT 'o_orderstatus' AS name, 'o_orderstatus' AS column_name, count(o_orderstatus) AS present FROM orders
UNION ALL SELECT 'o_orderpriority', 'o_orderpriority', count(o_orderpriority) FROM orders
""")
def q_protected_present(spark, sf):
    o = table(spark, sf, "orders")
    return _present(o, {c: c for c in fz.check_protected(o, ["o_orderstatus", "o_orderpriority"])})


@register("binary_targets", "CLEAN-5", f"""
WITH r AS ({S.ORDERS_SCORED})
SELECT 'rts_true' AS target, CAST(0 AS BIGINT) AS n_other, CAST(NULL AS VARCHAR) AS example, true AS is_binary
UNION ALL SELECT 'rtp_true', CAST(0 AS BIGINT), NULL, true
UNION ALL SELECT 'o_orderkey', count(*) FILTER (WHERE o_orderkey NOT IN (0, 1)),
                 min(CAST(o_orderkey AS VARCHAR)) FILTER (WHERE o_orderkey NOT IN (0, 1)),
                 count(*) FILTER (WHERE o_orderkey NOT IN (0, 1)) = 0 FROM r
""")
def q_binary_targets(spark, sf):
    return CL.binary_target_report(orders_scored(spark, sf), ["rts_true", "rtp_true", "o_orderkey"])


_LINEITEM_TYPES = {"l_orderkey": "bigint", "l_quantity": "double", "l_returnflag": "string"}


@register("column_types", "HEALTH-7", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM lineitem"
    for c, t in _LINEITEM_TYPES.items()))
def q_column_types(spark, sf):
    li = table(spark, sf, "lineitem").select(*_LINEITEM_TYPES)
    return (H.column_types(li).withColumnRenamed("column", "column_name")
            .join(H.missing_by_column(li).withColumnRenamed("column", "column_name"), "column_name"))
