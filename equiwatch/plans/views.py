"""Scored views over the test tables (two targets, three protected attributes).

Each view carries a row key, the ordering columns, ``rts_true``/``rts_pred``,
``rtp_true``/``rtp_pred`` (predicted RTP gated by predicted RTS) and the
protected attributes as text.  Columns are selected right at the scan so the
parquet reader only decodes what the view uses.

Join plan: the fact table is joined to its dimensions one at a time, so every
build side is a single (smaller) table.  No broadcast hints: Spark broadcasts a side only when its
size estimate is under ``spark.sql.autoBroadcastJoinThreshold`` (nation and
region always are), otherwise it plans a sort-merge join — a size check with
a fallback, and AQE re-checks with runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

ORDERS_PROTECTED = ("c_mktsegment", "r_name", "order_year")
DOCS_PROTECTED = ("lang", "source", "n_chars_mod3")
EVENTS_PROTECTED = ("user_mod3", "k_mod5")


def _i(c) -> F.Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def orders_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region with rule-based actual/predicted labels."""
    # Fact first, then dimensions: each join's build side is the smaller input
    # (customer at small scale; nation and region always), and at scale
    # orders ⋈ customer becomes a sort-merge join while the two dimension
    # joins stay broadcast (25 and 5 rows by definition of the schema).
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer", parallel=False).select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (orders.join(customer, orders.o_custkey == customer.c_custkey)
         .join(nation, F.col("c_nationkey") == nation.n_nationkey)
         .join(region, F.col("n_regionkey") == region.r_regionkey))
    rts_pred = _i(F.col("o_totalprice") >= 250000)
    return j.select(
        "o_orderkey", "o_orderdate",
        _i(F.col("o_orderstatus") == "F").alias("rts_true"),
        rts_pred.alias("rts_pred"),
        _i(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("rtp_true"),
        (rts_pred * _i(F.col("c_acctbal") >= 3000)).alias("rtp_pred"),
        "c_mktsegment", "r_name",
        F.year("o_orderdate").cast("string").alias("order_year"),
    )


def docs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels: small groups (20 sources), exercises the tpr=0 rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels", parallel=False).select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    rts_pred = _i(F.col("n_chars") >= 500)
    return j.select(
        "doc_id",
        _i(F.col("quality") == 1).alias("rts_true"),
        rts_pred.alias("rts_pred"),
        _i(F.col("toxic") == 0).alias("rtp_true"),
        (rts_pred * _i(F.col("n_chars") >= 1000)).alias("rtp_pred"),
        "lang", "source",
        F.pmod(F.col("n_chars"), F.lit(3)).cast("string").alias("n_chars_mod3"),
    )


def events_scored(spark: SparkSession, sf_dir: str, cast_ts: bool = False) -> DataFrame:
    """events: purchase/click labels against value rules.  ``ts`` stays
    ``timestamp_ntz`` unless ``cast_ts`` (then it is read in the session zone)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    rts_pred = _i(F.col("value") >= 35)
    return ev.select(
        "event_id", (F.col("ts").cast("timestamp") if cast_ts else F.col("ts")).alias("ts"),
        _i(F.col("event_type") == "purchase").alias("rts_true"),
        rts_pred.alias("rts_pred"),
        _i(F.col("event_type").isin("purchase", "click")).alias("rtp_true"),
        (rts_pred * _i(F.col("value") <= 100)).alias("rtp_pred"),
        F.pmod(F.col("user_id"), F.lit(3)).cast("string").alias("user_mod3"),
        F.pmod(k, F.lit(5)).cast("string").alias("k_mod5"),
    )


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders mapped onto the athlete-style signal names."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders", parallel=False).select("o_orderkey", "o_totalprice", "o_orderpriority",
                                              "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        "l_orderkey", "l_linenumber",
        (F.col("o_totalprice") / 5000).alias("performance_score"),
        (F.col("l_quantity") / 5).alias("fatigue_score"),
        (F.col("l_linenumber") - 1).cast("long").alias("recovery_days"),
        (F.col("l_discount") * 1000).alias("acl_risk_score"),
        (F.col("l_tax") * 100).alias("load_balance_score"),
        _i(F.col("l_returnflag") == "R").cast("long").alias("injury_indicator"),
        (F.col("l_extendedprice") / 10000).alias("team_contribution"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("l_shipdate").alias("ship_ts"),
    )


def row_key(*cols: str) -> F.Column:
    """Text key ``a-b-...`` from integer key columns (same text in any SQL engine)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("-"))
        parts.append(F.col(c).cast("string"))
    return F.concat(*parts)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rendered as messy text: money, percent, yes/no, mixed, non-finite.

    Junk and NULL cells are placed by the keyed hash draw, so any engine with
    md5 reproduces the same cells.
    """
    from ..functions.columns import hash_draw

    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    key = row_key("l_orderkey", "l_linenumber")
    d1, d2, d3, d4, d5 = (hash_draw(key, s) for s in (11, 12, 13, 14, 15))
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    dollars = F.floor(cents / 100).cast("long")
    dollar_txt = F.when(dollars >= 1000, F.concat(F.floor(dollars / 1000).cast("long").cast("string"), F.lit(","),
                                                  F.lpad((dollars % 1000).cast("string"), 3, "0"))) \
        .otherwise(dollars.cast("string"))
    money_txt = F.concat(F.lit("$"), dollar_txt, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    pct_txt = F.concat(F.floor(F.col("l_discount") * 100 + 0.5).cast("long").cast("string"), F.lit("%"))
    qty = F.col("l_quantity").cast("long").cast("string")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return li.select(
        key.alias("row_key"),
        F.when(d1 < 0.05, F.lit(None).cast("string")).when(d1 < 0.13, F.lit("x"))
         .when(d1 < 0.15, F.lit("12d")).otherwise(money_txt).alias("money"),
        F.when(d2 < 0.05, F.lit(None).cast("string")).when(d2 < 0.15, F.lit("n/a"))
         .otherwise(pct_txt).alias("pct"),
        F.when(d3 < 0.05, F.lit(None).cast("string")).when(d3 < 0.15, F.lit("maybe"))
         .when(F.col("l_linestatus") == "O", F.lit(" Yes")).otherwise(F.lit("no ")).alias("yn"),
        F.when(d4 < 0.35, F.concat(F.lit("about "), qty)).otherwise(qty).alias("qty_txt"),
        F.col("l_returnflag").alias("flag"),
        F.when(d5 < 0.02, nan).when(d5 < 0.04, inf).when(d5 < 0.06, -inf)
         .otherwise(F.col("l_tax")).alias("ratio"),
        (F.col("l_quantity") * 3).alias("qty3"),
        F.col("l_shipdate").alias("ship_ts"),
    )
