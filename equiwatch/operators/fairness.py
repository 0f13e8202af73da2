"""Group fairness of binary predictions: confusion counts, rates, gaps, alerts.

Shape of the computation (any number of targets, attributes and batches):

1. ``long_form``: ``inline`` over a fixed-size array (a ``Generate`` inside the
   scan stage) turns each row into one row per (target, attribute) with the
   group value, the actual and the predicted label.
2. ``confusion_by_group``: one hash aggregate on
   ``(*keys, target, attribute, grp)``.  The partial aggregate runs before the
   shuffle, so each task ships at most ``keys × targets × attributes × groups``
   rows; a hot group (a third of all rows) is collapsed map-side and never
   lands whole in one task.
3. ``fairness_gaps``: a second, tiny aggregate on ``(*keys, target, attribute)``.

No Python runs per row, no ``groupBy().applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_group_label, safe_rate  # noqa: F401  (re-exported)


@dataclass(frozen=True)
class Target:
    """A monitored label: its display name, actual column and predicted column."""

    name: str
    actual: str
    predicted: str


DEFAULT_TARGETS = (Target("RTS", "rts_true", "rts_pred"), Target("RTP", "rtp_true", "rtp_pred"))

GROUP_COLS = ("n", "tp", "tn", "fp", "fn")


def check_protected(df: DataFrame, protected: Sequence[str]) -> list[str]:
    """Fail when a protected column is absent; warn-level result when none chosen."""
    if not protected:
        raise ValueError("select at least one protected attribute for fairness monitoring")
    missing = [c for c in protected if c not in df.columns]
    if missing:
        raise ValueError(f"protected columns missing: {missing}")
    return list(protected)


MAX_GROUPS_HINT = 1000


def protected_cardinality(df: DataFrame, protected: Sequence[str]) -> DataFrame:
    """One row: approximate distinct count per protected column (HyperLogLog)."""
    return df.agg(*[F.approx_count_distinct(F.col(a)).alias(a) for a in protected])


def warn_high_cardinality(df: DataFrame, protected: Sequence[str], limit: int = MAX_GROUPS_HINT) -> list[str]:
    """Warn (and return the names) when a protected column has more than ``limit``
    groups — usually an id picked by mistake.  One aggregate pass."""
    import warnings
    row = protected_cardinality(df, protected).first()
    wide = [a for a in protected if (row[a] or 0) > limit]
    if wide:
        warnings.warn(f"protected columns with more than {limit} groups: {wide}", stacklevel=2)
    return wide


def group_counts(rates: DataFrame, limit: int = MAX_GROUPS_HINT) -> DataFrame:
    """attribute, n_groups, too_many (over ``limit``) from the per-group table behind a report: exact, no pass of its own."""
    seen = rates.groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("_n"))  # a group is there once a target
    return seen.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_groups")).withColumn(
        "too_many", F.col("n_groups") > F.lit(int(limit)))


def long_form(df: DataFrame, targets: Sequence[Target], protected: Sequence[str],
              keys: Sequence[str] = (), null_label: str = "Unknown") -> DataFrame:
    """Rows → (*keys, target, attribute, grp, y, y_hat), one per target × attribute.

    ``inline`` over a literal-sized array of structs (a ``Generate`` fused into
    the scan stage's generated code); only the key, label and protected columns
    are read, so pruning still reaches the scan."""
    check_protected(df, protected)
    rows = F.array(*[F.struct(F.lit(t.name).alias("target"), F.lit(a).alias("attribute"),
                              null_group_label(a, null_label).alias("grp"),
                              F.col(t.actual).cast("int").alias("y"),
                              F.col(t.predicted).cast("int").alias("y_hat"))
                     for t in targets for a in protected])
    return df.select(*keys, F.inline(rows))


def confusion_by_group(df: DataFrame, targets: Sequence[Target] = DEFAULT_TARGETS,
                       protected: Sequence[str] = (), keys: Sequence[str] = (),
                       null_label: str = "Unknown") -> DataFrame:
    """Per (keys, target, attribute, group): n, tp, tn, fp, fn."""
    long = long_form(df, targets, protected, keys, null_label)
    y, p = F.col("y"), F.col("y_hat")
    return (long.groupBy(*keys, "target", "attribute", "grp")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn")))


def group_rates(conf: DataFrame) -> DataFrame:
    """Adds selection_rate, tpr, fpr, accuracy (0.0 where a denominator is 0)."""
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    return (conf
            .withColumn("selection_rate", safe_rate(tp + fp, n))
            .withColumn("tpr", safe_rate(tp, tp + fn))
            .withColumn("fpr", safe_rate(fp, fp + tn))
            .withColumn("accuracy", safe_rate(tp + tn, tp + tn + fp + fn)))


def fairness_gaps(rates: DataFrame, keys: Sequence[str] = (), min_group_n: int = 1) -> DataFrame:
    """dp = max−min selection rate; eo = max(tpr gap, fpr gap); 0 with < 2 groups.

    ``min_group_n`` > 1 leaves groups with fewer rows out of the gaps (small
    batches make tiny groups noisy); the default keeps every group."""
    if min_group_n > 1:
        rates = rates.where(F.col("n") >= F.lit(int(min_group_n)))
    g = (rates.groupBy(*keys, "target", "attribute")
         .agg(F.count(F.lit(1)).alias("n_groups"),
              (F.max("selection_rate") - F.min("selection_rate")).alias("_dp"),
              F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("_eo")))
    many = F.col("n_groups") >= 2
    return (g.withColumn("dp_diff", F.when(many, F.col("_dp")).otherwise(F.lit(0.0)))
             .withColumn("eo_diff", F.when(many, F.col("_eo")).otherwise(F.lit(0.0)))
             .withColumn("protected_attr", F.concat_ws(":", "target", "attribute"))
             .drop("_dp", "_eo"))


def fairness_alert(gaps: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Strict: alert when either gap is *above* the threshold."""
    thr = F.lit(float(threshold))
    return gaps.withColumn("alert", (F.col("dp_diff") > thr) | (F.col("eo_diff") > thr))


def fairness_report(df: DataFrame, targets: Sequence[Target] = DEFAULT_TARGETS,
                    protected: Sequence[str] = (), threshold: float = 0.10,
                    keys: Sequence[str] = (), null_label: str = "Unknown",
                    min_group_n: int = 1) -> DataFrame:
    """One row per (keys, target, attribute): n_groups, dp_diff, eo_diff, alert."""
    rates = group_rates(confusion_by_group(df, targets, protected, keys, null_label))
    return fairness_alert(fairness_gaps(rates, keys, min_group_n), threshold)


def group_report(df: DataFrame, targets: Sequence[Target] = DEFAULT_TARGETS,
                 protected: Sequence[str] = (), keys: Sequence[str] = (),
                 null_label: str = "Unknown") -> DataFrame:
    """The per-group table behind the report (counts and rates)."""
    return group_rates(confusion_by_group(df, targets, protected, keys, null_label))


# ---------------------------------------------------------------------------
# History-level views over a per-batch report
# ---------------------------------------------------------------------------

def batch_summary(report: DataFrame, keys: Sequence[str] = ("batch",)) -> DataFrame:
    """Per batch: max dp, max eo, any alert over all (target, attribute) pairs."""
    return (report.groupBy(*keys)
            .agg(F.coalesce(F.max("dp_diff"), F.lit(0.0)).alias("max_dp_diff"),
                 F.coalesce(F.max("eo_diff"), F.lit(0.0)).alias("max_eo_diff"),
                 F.coalesce(F.bool_or("alert"), F.lit(False)).alias("alert")))


def worst_driver(report: DataFrame, threshold: float = 0.10, keys: Sequence[str] = ("batch",),
                 target_order: Sequence[str] = ("RTS", "RTP"),
                 attribute_order: Sequence[str] = ()) -> DataFrame:
    """Per batch: the (target, attribute) with the largest max(dp, eo).

    Ties go to the first in report order: targets in ``target_order``, then
    attributes in ``attribute_order`` (selection order).  The driver is
    "Demographic Parity" when dp >= eo, else "Equalized Odds"; ``stable`` when
    the severity is within the threshold.
    """
    t_rank = F.array_position(F.array(*[F.lit(t) for t in target_order]), F.col("target"))
    if attribute_order:
        a_rank = F.array_position(F.array(*[F.lit(a) for a in attribute_order]), F.col("attribute"))
    else:
        a_rank = F.lit(0)
    sev = F.greatest("dp_diff", "eo_diff")
    w = Window.partitionBy(*keys).orderBy(sev.desc(), t_rank.asc(), a_rank.asc(), F.col("attribute").asc())
    best = (report.withColumn("severity", sev)
            .withColumn("_rk", F.row_number().over(w))
            .where(F.col("_rk") == 1).drop("_rk"))
    thr = float(threshold)
    return best.select(
        *keys, "protected_attr", "dp_diff", "eo_diff", "severity",
        F.when(F.col("dp_diff") >= F.col("eo_diff"), F.lit("Demographic Parity"))
         .otherwise(F.lit("Equalized Odds")).alias("driver"),
        (F.col("severity") <= F.lit(thr)).alias("stable"),
        F.when(F.col("severity") <= F.lit(thr),
               F.format_string("stable across %s groups (DP=%.3f, EO=%.3f)",
                               "protected_attr", "dp_diff", "eo_diff"))
         .otherwise(F.format_string("bias mainly with %s: DP gap %.3f, EO gap %.3f",
                                    "protected_attr", "dp_diff", "eo_diff")).alias("message"))


def severity_bands(df: DataFrame, threshold: float = 0.10, value_col: str = "severity",
                   prefix: str = "") -> DataFrame:
    """bad > thr, warn > 0.7·thr, else good; severity % = min(v/thr, 1)·100; OK when v <= thr."""
    v, thr = F.col(value_col), F.lit(float(threshold))
    return (df.withColumn(f"{prefix}mood", F.when(v > thr, F.lit("bad"))
                          .when(v > thr * F.lit(0.7), F.lit("warn")).otherwise(F.lit("good")))
              .withColumn(f"{prefix}severity_pct", F.least(v / thr, F.lit(1.0)) * F.lit(100.0))
              .withColumn(f"{prefix}status", F.when(v <= thr, F.lit("OK")).otherwise(F.lit("ALERT"))))


def attr_summary(report: DataFrame, threshold: float = 0.10, keys: Sequence[str] = ("batch",)) -> DataFrame:
    """Row per attribute: dp, eo, severity rounded to 3 decimals (ties to even), status."""
    sev = F.greatest("dp_diff", "eo_diff")
    return report.select(
        *keys, "protected_attr",
        F.bround("dp_diff", 3).alias("dp"),
        F.bround("eo_diff", 3).alias("eo"),
        F.bround(sev, 3).alias("severity"),
        F.when(sev <= F.lit(float(threshold)), F.lit("OK")).otherwise(F.lit("ALERT")).alias("status"))
