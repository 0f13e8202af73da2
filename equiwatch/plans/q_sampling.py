"""Registered sampling / split / batch / ordering / projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fairness as fz
from ..operators import labels as L
from ..operators import names as N
from ..operators import sampling as SM
from ..operators.ordering import global_rank, running_sums
from ..sources.tables import table
from . import sqltext as S
from .registry import finish, register
from .views import ORDERS_PROTECTED, orders_scored, readiness, row_key

_HD7 = S.hash_draw("o_orderkey", 7)
_HD42 = S.hash_draw("o_orderkey", 42)


@register("hash_draw", "SAMP-0", f"SELECT o_orderkey, round({_HD7}, 6) AS draw FROM orders")
def q_hash_draw(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return finish(SM.with_draw(o, "o_orderkey", 7))


@register("sample_fraction", "SAMP-1", f"""
SELECT o_orderkey, o_orderstatus, round({_HD7}, 6) AS draw FROM orders WHERE {_HD7} < 0.35
""")
def q_sample_fraction(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return finish(SM.sample_fraction(o, "o_orderkey", 0.35, 7))


@register("sample_fraction_exact", "SAMP-1", f"""
WITH d AS (SELECT o_orderkey, o_orderstatus, {_HD7} AS draw FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY draw, o_orderkey) AS rn, count(*) OVER () AS n FROM d)
SELECT o_orderkey, o_orderstatus, round(draw, 6) AS draw FROM r WHERE rn <= round_even(n * 0.35, 0)
""")
def q_sample_fraction_exact(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return finish(SM.sample_fraction(o, "o_orderkey", 0.35, 7, exact=True))


@register("sample_n", "SAMP-2", f"""
SELECT o_orderkey, o_totalprice, round({_HD42}, 6) AS draw FROM orders ORDER BY {_HD42}, o_orderkey LIMIT 200
""")
def q_sample_n(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return finish(SM.sample_n(o, "o_orderkey", 200, 42))


@register("split_hash", "SPLIT-1", f"""
SELECT o_orderkey, CASE WHEN {_HD42} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders
""")
def q_split_hash(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return SM.split_hash(o, "o_orderkey", 0.2, 42)


_STRAT_CTES = f"""
WITH s AS ({S.ORDERS_SCORED}),
d AS (SELECT o_orderkey, rts_true, rtp_true, CAST(rts_true AS BIGINT) AS cls, {_HD42} AS draw FROM s),
c AS (SELECT cls, count(*) AS cnt FROM d GROUP BY cls),
t AS (SELECT cls, cnt, sum(cnt) OVER () AS ntot, ceil(CAST(sum(cnt) OVER () AS DOUBLE) * 0.2) AS ntest,
             count(*) OVER () AS ncls FROM c),
b AS (SELECT *, floor(CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE)) AS base,
             CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE)
             - floor(CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE)) AS rem FROM t),
q AS (SELECT cls, CASE WHEN ncls = 1 THEN ntest ELSE base + CASE WHEN
             row_number() OVER (ORDER BY rem DESC, cls ASC) <= ntest - sum(base) OVER () THEN 1 ELSE 0 END END AS quota
      FROM b),
sp AS (SELECT d.o_orderkey, d.rts_true, d.rtp_true,
              CASE WHEN row_number() OVER (PARTITION BY d.cls ORDER BY d.draw, d.o_orderkey) <= q.quota
                   THEN 'test' ELSE 'train' END AS split
       FROM d JOIN q ON d.cls = q.cls)
"""


def _split(spark, sf):
    s = orders_scored(spark, sf).select("o_orderkey", "rts_true")
    return SM.stratified_split(s, "o_orderkey", "rts_true", 0.2, 42)


@register("stratified_split", "SPLIT-1", _STRAT_CTES + "SELECT o_orderkey, rts_true, split FROM sp")
def q_stratified_split(spark, sf):
    return _split(spark, sf)


@register("align_labels", "SPLIT-2", _STRAT_CTES + "SELECT o_orderkey, split, rts_true, rtp_true FROM sp")
def q_align_labels(spark, sf):
    rtp = orders_scored(spark, sf).select("o_orderkey", "rtp_true")
    return SM.align_labels(_split(spark, sf), rtp, "o_orderkey").select("o_orderkey", "split", "rts_true", "rtp_true")


@register("class_guard", "SPLIT-3", _STRAT_CTES + """
, l AS (SELECT split, 'rts_true' AS target, rts_true AS y FROM sp UNION ALL SELECT split, 'rtp_true', rtp_true FROM sp)
SELECT split, target, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg,
       count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 AS both_classes
FROM l GROUP BY split, target
""")
def q_class_guard(spark, sf):
    s = orders_scored(spark, sf).select("o_orderkey", "rts_true", "rtp_true")
    return SM.class_guard(SM.stratified_split(s, "o_orderkey", "rts_true", 0.2, 42), ["rts_true", "rtp_true"])


@register("global_rank", "ORD-0", """
SELECT l_orderkey, l_linenumber,
       row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_id
FROM lineitem
""")
def q_global_rank(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return global_rank(li, ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_id")


_RUN = "rows BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("global_running_sum", "ORD-0", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, CAST(l_quantity AS BIGINT) AS quantity,
                  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                  CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey END AS part_key FROM lineitem),
o AS (SELECT *, sum(quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, cents, quantity, l_returnflag {_RUN}) AS q,
             sum(cents) OVER (PARTITION BY l_returnflag
                              ORDER BY l_shipdate, l_orderkey, l_linenumber, cents, quantity {_RUN}) AS c,
             sum(part_key) OVER (PARTITION BY l_returnflag
                             ORDER BY l_shipdate, l_orderkey, l_linenumber, cents, quantity {_RUN}) AS s FROM t)
SELECT l_orderkey, l_linenumber, CAST(q AS BIGINT) AS quantity_to_date, CAST(c AS BIGINT) AS cents_of_flag_to_date,
       CAST(s AS BIGINT) AS some_of_flag_to_date FROM o
""")
def q_global_running_sum(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_quantity").cast("bigint").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "cents", "quantity"]
    whole = running_sums(li, [*order, "l_returnflag"], {"quantity_to_date": "quantity"})
    some = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_orderkey"))
    return running_sums(whole, order, {"cents_of_flag_to_date": "cents", "some_of_flag_to_date": some},
                        groups=["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "quantity_to_date", "cents_of_flag_to_date", "some_of_flag_to_date")


@register("assign_batches", "BATCH-1", f"""
WITH d AS (SELECT o_orderkey, {_HD7} AS draw FROM orders WHERE {_HD7} < 0.35),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY draw, o_orderkey) AS position FROM d)
SELECT o_orderkey, position, CAST((position - 1) // 100 + 1 AS BIGINT) AS batch FROM r
""")
def q_assign_batches(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    d = SM.sample_fraction(o, "o_orderkey", 0.35, 7)
    return SM.assign_batches(d, ["draw", "o_orderkey"], 100).select("o_orderkey", "position", "batch")


_ORDERS = S.fairness_ctes(S.ORDERS_SCORED, ORDERS_PROTECTED)


@register("union_targets", "UNION-1", _ORDERS + """
SELECT target, attribute, n_groups, round(dp_diff, 6) AS dp_diff, round(eo_diff, 6) AS eo_diff, protected_attr, alert
FROM report
""")
def q_union_targets(spark, sf):
    s = orders_scored(spark, sf)
    parts = [fz.fairness_report(s, [t], ORDERS_PROTECTED) for t in fz.DEFAULT_TARGETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finish(out)


@register("sorted_groups", "SORT-1", _ORDERS + """
SELECT target, attribute, grp, n FROM conf ORDER BY target, attribute, grp
""")
def q_sorted_groups(spark, sf):
    conf = fz.confusion_by_group(orders_scored(spark, sf), protected=ORDERS_PROTECTED)
    return conf.select("target", "attribute", "grp", "n").orderBy("target", "attribute", "grp")


@register("feature_projection", "PROJ-1", f"""
WITH r AS ({S.READINESS})
SELECT l_orderkey, l_linenumber, recovery_days, acl_risk_score, injury_indicator, team_contribution,
       priority, status, ship_ts FROM r
""")
def q_feature_projection(spark, sf):
    r = readiness(spark, sf)
    lab = L.derive_labels(r, row_key("l_orderkey", "l_linenumber"))
    m = N.default_mapping(lab.columns)
    return SM.feature_projection(lab, [m.rts_target, m.rtp_target], m.drop)


_TRAIN_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("acl_risk_score", T.DoubleType()), T.StructField("strength_index", T.DoubleType()),
    T.StructField("recovery_days", T.LongType()), T.StructField("priority", T.StringType()),
])


@register("align_to_schema", "PROJ-2", f"""
WITH r AS ({S.READINESS})
SELECT l_orderkey, l_linenumber, round(acl_risk_score, 6) AS acl_risk_score, CAST(NULL AS DOUBLE) AS strength_index,
       recovery_days, priority FROM r
""")
def q_align_to_schema(spark, sf):
    return finish(SM.align_to_schema(readiness(spark, sf), _TRAIN_SCHEMA))


@register("global_quantiles", "ORD-0/LAB", f"""
WITH r AS ({S.READINESS})
SELECT round(quantile_cont(performance_score, 0.35), 6) AS p35_perf,
       round(quantile_cont(performance_score, 0.55), 6) AS p55_perf,
       round(quantile_cont(load_balance_score, 0.35), 6) AS p35_balance,
       round(quantile_cont(fatigue_score, 0.8), 6) AS p80_fatigue,
       round(quantile_cont(team_contribution, 0.5), 6) AS median_team
FROM r
""")
def q_global_quantiles(spark, sf):
    r = readiness(spark, sf)
    specs = {"p35_perf": (F.col("performance_score"), 0.35), "p55_perf": (F.col("performance_score"), 0.55),
             "p35_balance": (F.col("load_balance_score"), 0.35), "p80_fatigue": (F.col("fatigue_score"), 0.8),
             "median_team": (F.col("team_contribution"), 0.5)}
    return finish(L.percentiles(r, specs, method="distributed"))

