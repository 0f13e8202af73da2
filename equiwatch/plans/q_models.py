"""Registered preparation / model / explanation queries (PREP, ML, EVAL on
models, SINK-2, SHAP) and the end-to-end monitored replay.

Model queries train on the readiness view: labels from the rule chain, the
features left after the default drop list, 80/20 split by keyed draw.  Library
defaults equal the monitored application's settings (250 boosting rounds, 300
forest trees, depth up to 30) and hold for the registry too, which fits on every
row of the training part.  Trained models are memoised per
session and data folder, so the queries below train each model once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import fairness as fz
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import names as N
from ..operators import prep as P
from ..operators import sampling as SM
from ..operators.cleaning import fit_cleaning
from ..operators.constants import with_constants
from ..operators.ordering import global_rank, materialize, written
from ..session import scratch_path
from ..sources.tables import table
from . import q_labels as QL
from . import sqltext as S
from .q_health import docs_labels
from .registry import finish, register
from .views import orders_scored, readiness, row_key

KEYS = ("row_id",)              # unique; (l_orderkey, l_linenumber) repeats in lineitem
SOURCE_KEYS = ("l_orderkey", "l_linenumber")
ML_PROTECTED = ("priority", "status")

# ---------------------------------------------------------------------------
# PREP-1..4 on documents ⟕ labels (missing labels), fitted on the train split
# ---------------------------------------------------------------------------

_DOC_NUM = ("n_chars", "quality", "toxic")
_DOC_SPLIT = f"CASE WHEN {S.hash_draw('doc_id', 42)} < 0.2 THEN 'test' ELSE 'train' END"
_DOCS_SQL = f"""
WITH t AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, {_DOC_SPLIT.replace('doc_id', 'd.doc_id')} AS split
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT {", ".join(f"median(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train') AS med_{c}" for c in _DOC_NUM)} FROM t),
i AS (SELECT t.doc_id, t.lang, t.source, t.split,
             {", ".join(f"COALESCE(CAST(t.{c} AS DOUBLE), m.med_{c}) AS {c}" for c in _DOC_NUM)} FROM t, m)
"""


def _docs_split(spark, sf):
    return SM.split_hash(docs_labels(spark, sf).drop("text"), "doc_id", 0.2, 42)


@register("impute_median", "PREP-1", _DOCS_SQL + f"""
SELECT doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in _DOC_NUM)} FROM i
""")
def q_impute_median(spark, sf):
    d = _docs_split(spark, sf)
    med = P.medians(d.where("split = 'train'"), _DOC_NUM)
    return finish(P.impute_median(d.select("doc_id", *_DOC_NUM), med))


@register("standardize", "PREP-2", _DOCS_SQL + f"""
, s AS (SELECT {", ".join(f"avg({c}) FILTER (WHERE split = 'train') AS a_{c}, "
                          f"stddev_pop({c}) FILTER (WHERE split = 'train') AS s_{c}" for c in _DOC_NUM)} FROM i)
SELECT doc_id, {", ".join(f"round((({c}) - s.a_{c}) / (CASE WHEN s.s_{c} IS NULL OR s.s_{c} = 0 THEN 1.0 ELSE s.s_{c} END), 6) AS {c}"
                          for c in _DOC_NUM)}
FROM i, s
""")
def q_standardize(spark, sf):
    d = _docs_split(spark, sf)
    med = P.medians(d.where("split = 'train'"), _DOC_NUM)
    imp = P.impute_median(d.select("doc_id", "split", *_DOC_NUM), med)
    mom = P.moments(imp.where("split = 'train'"), _DOC_NUM)
    return finish(P.standardize(imp, mom).drop("split"))


@register("impute_mode", "PREP-3", f"""
WITH t AS (SELECT lang, source FROM documents WHERE {S.hash_draw('doc_id', 42)} >= 0.2),
l AS (SELECT 'lang' AS "column", lang AS value FROM t UNION ALL SELECT 'source', source FROM t),
c AS (SELECT "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY "column", value),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rank FROM c)
SELECT "column" AS column_name, value AS mode, count FROM r WHERE rank = 1
""")
def q_impute_mode(spark, sf):
    d = _docs_split(spark, sf).where("split = 'train'")
    t = P.mode_table(d, ["lang", "source"]).where("rank = 1")
    return t.select(F.col("column").alias("column_name"), F.col("value").alias("mode"), "count")


@register("one_hot", "PREP-4", """
SELECT doc_id, """ + ", ".join(f"CAST(CASE WHEN lang = '{k}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS lang_{k}"
                                for k in ("de", "en", "es", "fr"))
          + " FROM documents")
def q_one_hot(spark, sf):
    d = _docs_split(spark, sf)
    train = d.where("split = 'train'")
    mode = P.modes(train, ["lang"])
    cats = P.categories(train.select("lang"), ["lang"])
    return d.select("doc_id", *P.one_hot_exprs("lang", cats["lang"], mode["lang"]))


# ---------------------------------------------------------------------------
# Models on the readiness view
# ---------------------------------------------------------------------------

_MEMO: dict = {}


def ml_frame(spark, sf):
    """Readiness rows with derived, gated labels, a unique ``row_id`` (distributed
    rank over all columns; fully identical rows are interchangeable) and an exact
    stratified split by ``rts``.  Types are cleaned by the fitted models."""
    lab = L.derive_labels(readiness(spark, sf), row_key(*SOURCE_KEYS))
    ranked = written(global_rank(lab, [F.col(c) for c in lab.columns], out="row_id"), "ml-ranked")
    return SM.stratified_split(ranked, "row_id", "rts", 0.2, 42)


def ml_features(df) -> list[str]:
    m = N.default_mapping(df.columns)
    skip = set(KEYS) | set(SOURCE_KEYS) | {m.rts_target, m.rtp_target, "split"} | set(m.drop)
    return [c for c in df.columns if c not in skip]


def _prepared(spark, sf):
    """Rows with labels and split, features, fitted cleaning and preparation, and the training part counted by cell."""
    key = (id(spark), sf)
    if key not in _MEMO:
        data = written(ml_frame(spark, sf), "ml-rows")
        feats = ml_features(data)
        train = data.where("split = 'train'")
        guard = SM.class_guard(train, ["rts", "rtp"])
        SM.require_both_classes(guard)
        rules = fit_cleaning(train, feats)
        prep = P.fit_prep(rules.transform(train), feats)
        binned = MD.bin_rows(prep.transform(rules.transform(train)), ["rts", "rtp"], len(prep.feature_names))
        _MEMO[key] = (data, feats, rules, prep, binned)
    return _MEMO[key]


def trained(spark, sf, kind: str = "gbt"):
    """Both targets' models, fitted on all rows of the training part."""
    key = (id(spark), sf, kind)
    if key not in _MEMO:
        data, feats, rules, prep, binned = _prepared(spark, sf)
        train = data.where("split = 'train'")

        def fit(t):
            return MD.fit_target(train, t.upper(), t, feats, kind=kind, prep=prep, cleaning=rules, binned=binned)

        with ThreadPoolExecutor(2) as pool:  # boosting waits for its rounds most of the time
            models = dict(zip(("rts", "rtp"), pool.map(fit, ("rts", "rtp")), strict=True))
        _MEMO[key] = (data, feats, prep, models)
    return _MEMO[key]


def _scored(spark, sf, kind: str = "gbt", split: str | None = None, part=lambda rows: rows):
    """Rows (of one part of the split, and of ``part``) with both predictions, gated."""
    data, _, _, models = trained(spark, sf, kind)
    rows = part(data if split is None else data.where(F.col("split") == split))
    out = MD.predict_each(rows, [(models["rts"], "rts_pred", "rts_prob"), (models["rtp"], "rtp_pred_raw", "rtp_prob")])
    return MD.predict_gated(out.withColumn("rtp_pred", F.col("rtp_pred_raw")))


def _model_metrics(spark, sf, kind):
    s = _scored(spark, sf, kind, "test").select("rts", "rtp", "rts_pred", "rtp_pred", "rts_prob", "rtp_prob")
    s = materialize(s)  # three metrics read it
    targets = [fz.Target("RTS", "rts", "rts_pred"), fz.Target("RTP", "rtp", "rtp_pred")]
    cm = M.classification_metrics(s, targets)
    auc_rts = M.roc_auc(s, "rts", "rts_prob").select(F.lit("RTS").alias("target"), "auc")
    auc_rtp = M.roc_auc(s, "rtp", "rtp_prob").select(F.lit("RTP").alias("target"), "auc")
    return finish(cm.join(auc_rts.unionByName(auc_rtp), "target"))


@register("train_gbt", "ML-1/EVAL")
def q_train_gbt(spark, sf):
    return _model_metrics(spark, sf, "gbt")


@register("train_rf", "ML-2/EVAL")
def q_train_rf(spark, sf):
    return _model_metrics(spark, sf, "rf")


#: Held-out ROC AUC that a fitted model of either kind must reach for each target.
LEAST_AUC = 0.85

_QUALITY = "SELECT 'RTS' AS target, true AS auc_reached UNION ALL SELECT 'RTP', true"


def _quality(spark, sf, kind):
    """Per target: whether the held-out AUC reaches its bound."""
    return _model_metrics(spark, sf, kind).select("target", (F.col("auc") >= LEAST_AUC).alias("auc_reached"))


@register("gbt_quality", "ML-1", _QUALITY)
def q_gbt_quality(spark, sf):
    return _quality(spark, sf, "gbt")


@register("rf_quality", "ML-2", _QUALITY)
def q_rf_quality(spark, sf):
    return _quality(spark, sf, "rf")


@register("class_weights", "ML-3", f"""
WITH r AS ({S.READINESS}),
l AS (SELECT l_orderkey, l_linenumber,
             CAST(COALESCE(COALESCE(CAST(injury_indicator AS DOUBLE), 1.0) = 0 AND acl_risk_score <= 55
                  AND fatigue_score <= 5 AND recovery_days >= 1, false) AS INTEGER) AS rts FROM r
      WHERE {S.hash_draw(S.row_key('l_orderkey', 'l_linenumber'), 42)} >= 0.2),
c AS (SELECT rts, count(*) AS n_cls FROM l GROUP BY rts)
SELECT l.l_orderkey, l.l_linenumber, l.rts,
       round(CAST((SELECT count(*) FROM l) AS DOUBLE) / (2.0 * c.n_cls), 6) AS class_weight
FROM l JOIN c ON l.rts = c.rts
""")
def q_class_weights(spark, sf):
    r = L.derive_labels(readiness(spark, sf), row_key(*SOURCE_KEYS))
    train = SM.split_hash(r, row_key(*SOURCE_KEYS), 0.2, 42).where("split = 'train'").select(*SOURCE_KEYS, "rts")
    return finish(MD.class_weights(train, "rts").select(*SOURCE_KEYS, "rts", F.col("class_weight").cast("double")))


@register("prep_pipeline", "PREP-5")
def q_prep_pipeline(spark, sf):
    data, _, _, models = trained(spark, sf)
    enc = models["rts"].encode(data)
    return enc.select(*KEYS, vector_to_array("features").alias("features"))


_ML_COLS = ("l_orderkey", "l_linenumber", "performance_score", "fatigue_score", "recovery_days", "acl_risk_score",
            "load_balance_score", "injury_indicator", "team_contribution", "priority", "status", "ship_ts", "rts", "rtp")
_ML_NUM = {"recovery_days": "CAST(recovery_days AS DOUBLE)", "acl_risk_score": "acl_risk_score",
           "injury_indicator": "CAST(injury_indicator AS DOUBLE)", "team_contribution": "team_contribution",
           "ship_ts": "CAST(epoch(ship_ts) AS DOUBLE)"}
_ML_TEXT = ("priority", "status")


def _prep_sql() -> str:
    """Every prepared value from the tables: labels, row numbers, stratified split, constants of the training part, slots."""
    num = ", ".join(f"{e} AS {c}" for c, e in _ML_NUM.items())
    med = ", ".join(f"median({c}) AS m_{c}" for c in _ML_NUM)
    full = ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in _ML_NUM)
    moments = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _ML_NUM)
    std = ", ".join(f"round((i.{c} - a_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END), 6) AS {c}"
                    for c in _ML_NUM)
    modes = ", ".join(f"COALESCE({c}, (SELECT {c} FROM x WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
                      f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in _ML_TEXT)
    slots = ", ".join(f"k_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS slot "
                      f"FROM (SELECT DISTINCT {c} AS v FROM i WHERE split = 'train'))" for c in _ML_TEXT)
    return f"""
WITH r AS ({S.READINESS}) {QL._RTP_Q},
lab AS (SELECT r.*, CAST({QL._INJ_COND} AS INTEGER) AS rts,
               CAST(CASE WHEN CAST({QL._INJ_COND} AS INTEGER) = 0 THEN 0 ELSE CAST({QL._RTP_COND} AS INTEGER) END AS INTEGER) AS rtp
        FROM r, q),
n AS (SELECT *, row_number() OVER (ORDER BY {", ".join(f"{c} ASC NULLS FIRST" for c in _ML_COLS)}) AS row_id FROM lab),
c AS (SELECT rts AS cls, count(*) AS cnt FROM n GROUP BY rts),
t AS (SELECT cls, cnt, sum(cnt) OVER () AS ntot, ceil(CAST(sum(cnt) OVER () AS DOUBLE) * 0.2) AS ntest, count(*) OVER () AS ncls FROM c),
b AS (SELECT *, floor(CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE)) AS base,
             CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE) - floor(CAST(cnt AS DOUBLE) * ntest / CAST(ntot AS DOUBLE)) AS rem
      FROM t),
u AS (SELECT cls, CASE WHEN ncls = 1 THEN ntest ELSE base + CASE WHEN
             row_number() OVER (ORDER BY rem DESC, cls ASC) <= ntest - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM b),
x AS (SELECT row_id, {num}, {", ".join(_ML_TEXT)},
             CASE WHEN row_number() OVER (PARTITION BY rts ORDER BY {S.hash_draw('row_id', 42)}, row_id) <= u.quota
                  THEN 'test' ELSE 'train' END AS split
      FROM n JOIN u ON n.rts = u.cls),
med AS (SELECT {med} FROM x WHERE split = 'train'),
i AS (SELECT row_id, split, {full}, {modes} FROM x, med),
s AS (SELECT {moments} FROM i WHERE split = 'train'),
{slots}
SELECT i.row_id, {std}, {", ".join(f"k_{c}.slot AS {c}_slot" for c in _ML_TEXT)}
FROM i CROSS JOIN s {" ".join(f"LEFT JOIN k_{c} ON i.{c} = k_{c}.v" for c in _ML_TEXT)}
"""


@register("prep_values", "PREP-5", _prep_sql())
def q_prep_values(spark, sf):
    """The prepared matrix column by column: standardized numbers, and the slot of each text's one."""
    data, _, prep, models = trained(spark, sf)
    x = vector_to_array("features")
    numbers = [F.get(x, F.lit(prep.numeric.index(c))).alias(c) for c in _ML_NUM]
    at, slots = len(prep.numeric), []
    for c in prep.categorical:
        n = len(prep.categories[c])
        place = F.array_position(F.slice(x, at + 1, n), 1.0)
        slots.append(F.when(place > 0, place - 1).cast("int").alias(f"{c}_slot"))
        at += n
    return finish(models["rts"].encode(data).select(*KEYS, *numbers, *slots))


@register("predict", "ML-4")
def q_predict(spark, sf):
    s = _scored(spark, sf)
    return finish(s.select(*KEYS, "rts_pred", "rts_prob", "rtp_pred_raw", "rtp_prob"))


@register("predict_gated", "ML-5")
def q_predict_gated(spark, sf):
    return _scored(spark, sf).select(*KEYS, "rts_pred", "rtp_pred")


@register("model_save_load", "SINK-2")
def q_model_save_load(spark, sf):
    data, _, _, models = trained(spark, sf)
    path = scratch_path(spark, "model-bundle")
    MD.save_target_model(models["rtp"], path)
    back = MD.load_target_model(spark, path)
    j = MD.predict_each(data, [(models["rtp"], "pred_a", "prob_a"), (back, "pred_b", "prob_b")])
    return finish(j.select(*KEYS, F.col("pred_b").alias("pred"), F.col("prob_b").alias("prob"),
                           ((F.col("pred_a") == F.col("pred_b")) & (F.col("prob_a") == F.col("prob_b"))).alias("same")))


def _attributions(spark, sf, kind: str = "gbt"):
    data, _, prep, models = trained(spark, sf, kind)
    enc = models["rtp"].encode(data)
    return enc, X.tree_attributions(enc, models["rtp"].model, list(KEYS)), prep.feature_names


def _attribution_sums(spark, sf, kind: str):
    """Per row: every encoded feature with its attribution, their sum, and how far it is from the model's output."""
    _, attr, names = _attributions(spark, sf, kind)
    total = F.aggregate("attributions", F.lit(0.0), lambda acc, v: acc + v)
    each = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("attributions").alias("contribution")),
                       lambda c: F.struct(c["feature"].alias("feature"), F.round(c["contribution"], 6).alias("contribution")))
    return finish(attr.select(*KEYS, each.alias("attributions"), "expected_value", "model_output", total.alias("attribution_sum"),
                              F.abs(total + F.col("expected_value") - F.col("model_output")).alias("additivity_error")))


@register("tree_attributions", "SHAP-1")
def q_tree_attributions(spark, sf):
    return _attribution_sums(spark, sf, "gbt")


@register("forest_attributions", "SHAP-1 (forest)")
def q_forest_attributions(spark, sf):
    return _attribution_sums(spark, sf, "rf")


_ADD_UP = "SELECT count(*) AS n_rows, count(*) AS n_additive, count(*) AS n_as_predicted FROM lineitem"


def _add_up(spark, sf, kind: str):
    """Rows whose attributions sum to the output, and whose output is what the model itself predicts."""
    rows = _attribution_sums(spark, sf, kind)
    own = trained(spark, sf, kind)[3]["rtp"].predict(trained(spark, sf, kind)[0], "_pred", "_prob").select(*KEYS, "_prob")
    out = F.col("model_output")
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * out)) if kind == "gbt" else out
    return rows.join(own, list(KEYS)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("additivity_error") <= 1e-6).alias("n_additive"),
        F.count_if(F.abs(prob - F.col("_prob")) <= 1e-5).alias("n_as_predicted"))


@register("feature_importance", "SHAP-2 (model)")
def q_feature_importance(spark, sf):
    _, _, prep, models = trained(spark, sf)
    return finish(X.model_feature_importance(spark, models["rtp"].model, prep.feature_names))


@register("global_importance", "SHAP-2")
def q_global_importance(spark, sf):
    _, attr, names = _attributions(spark, sf)
    return finish(X.global_importance(attr, names, list(KEYS)))


@register("contribution_table", "SHAP-3")
def q_contribution_table(spark, sf):
    data, _, prep, models = trained(spark, sf)
    first = SM.sample_n(data.select("row_id"), "row_id", 1, 42).first()[0]
    enc = models["rtp"].encode(data.where(F.col("row_id") == first))   # only this row is attributed
    attr = X.tree_attributions(enc, models["rtp"].model, list(KEYS))
    return finish(X.contribution_table(enc, attr, prep.feature_names, "row_id", first))


@register("attributions_add_up", "SHAP-1", _ADD_UP)
def q_attributions_add_up(spark, sf):
    return _add_up(spark, sf, "gbt")


@register("forest_attributions_add_up", "SHAP-1 (forest)", _ADD_UP)
def q_forest_attributions_add_up(spark, sf):
    return _add_up(spark, sf, "rf")


@register("importance_adds_up", "SHAP-2", """
SELECT count(*) AS n_rows, true AS contributions_add_up, true AS largest_first, true AS absolute_is_larger FROM lineitem
""")
def q_importance_adds_up(spark, sf):
    """The mean contributions of all features and the expected value make the mean output; the table is in order."""
    _, attr, names = _attributions(spark, sf)
    attr = materialize(attr)
    table_ = X.global_importance(attr, names, list(KEYS)).collect()  # a row per feature
    whole = attr.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.avg(F.col("model_output") - F.col("expected_value")).alias("mean"))
    size = [r["mean_abs_contribution"] for r in table_]
    total = sum(r["mean_contribution"] for r in table_)
    return whole.select("n_rows", (F.abs(F.col("mean") - F.lit(total)) <= 1e-6).alias("contributions_add_up"),
                        F.lit(size == sorted(size, reverse=True)).alias("largest_first"),
                        F.lit(all(r["mean_abs_contribution"] >= abs(r["mean_contribution"]) - 1e-12 for r in table_)
                              and len(table_) == len(names)).alias("absolute_is_larger"))


@register("contribution_table_adds_up", "SHAP-3", """
SELECT true AS contributions_add_up, true AS largest_first, true AS values_are_the_rows
""")
def q_contribution_table_adds_up(spark, sf):
    """The table of one row: contributions make its output, by size, beside the row's own encoded values."""
    data, _, prep, models = trained(spark, sf)
    first = SM.sample_n(data.select("row_id"), "row_id", 1, 42).first()[0]
    enc = models["rtp"].encode(data.where(F.col("row_id") == first))
    attr = materialize(X.tree_attributions(enc, models["rtp"].model, list(KEYS)))
    rows = X.contribution_table(enc, attr, prep.feature_names, "row_id", first).collect()
    one, x = attr.first(), enc.select(vector_to_array("features")).first()[0]
    sizes = [abs(r["contribution"]) for r in rows]
    total = sum(r["contribution"] for r in rows) + one["expected_value"]
    known = {r["feature"]: r["value"] for r in rows} == dict(zip(prep.feature_names, x))
    return spark.range(1).select(F.lit(abs(total - one["model_output"]) <= 1e-6).alias("contributions_add_up"),
                                 F.lit(sizes == sorted(sizes, reverse=True)).alias("largest_first"),
                                 F.lit(known).alias("values_are_the_rows"))


@register("model_reload_same", "SINK-2", """
SELECT count(*) AS n_rows, count(*) AS n_same FROM lineitem
""")
def q_model_reload_same(spark, sf):
    return q_model_save_load(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("same").alias("n_same"))


@register("predict_all_rows", "ML-4", """
SELECT count(*) AS n_rows, count(*) AS n_valid, count(*) AS n_gated FROM lineitem
""")
def q_predict_all_rows(spark, sf):
    s, raw = _scored(spark, sf), F.col("rtp_pred_raw")
    valid = F.col("rts_prob").between(0, 1) & F.col("rtp_prob").between(0, 1) & F.col("rts_pred").isin(0, 1) & raw.isin(0, 1)
    gated = F.col("rtp_pred") == F.when((F.col("rts_pred") == 1) & (raw == 1), 1).otherwise(0)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"), F.count_if(gated).alias("n_gated"))


@register("gate_rule_predictions", "ML-5", f"""
SELECT o_orderkey, rts_pred, CASE WHEN rts_pred = 1 AND rtp_pred = 1 THEN 1 ELSE 0 END AS rtp_pred
FROM ({S.ORDERS_SCORED})
""")
def q_gate_rule_predictions(spark, sf):
    return MD.predict_gated(orders_scored(spark, sf)).select("o_orderkey", "rts_pred", "rtp_pred")


@register("one_hot_wide", "PREP-4", f"""
WITH t AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS v,
                  {S.hash_draw('o_orderkey', 42)} >= 0.2 AS fitted FROM orders),
c AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT v FROM t WHERE fitted))
SELECT t.o_orderkey, c.slot, CAST((SELECT count(*) FROM c) AS INTEGER) AS slots FROM t LEFT JOIN c ON t.v = c.v
""")
def q_one_hot_wide(spark, sf):
    o = SM.split_hash(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust")),
                      "o_orderkey", 0.2, 42)
    slots = materialize(P.category_slots(o.where("split = 'train'"), "cust"))
    enc = with_constants(P.with_slot(o, "cust", slots, "slot"), slots.agg(F.count(F.lit(1)).alias("slots")))
    return enc.select("o_orderkey", F.col("slot").cast("int").alias("slot"), F.col("slots").cast("int").alias("slots"))


def _monitor(spark, sf, kind: str, split: str | None = None):
    """The monitored replay with real models: 35% of all rows, or of one part of the
    split only (seed 7), batches of 100 in draw order, both predictions, gating, per-batch fairness by the
    protected columns (they stay in the features, as in the application)."""
    s = _scored(spark, sf, kind, split, lambda rows: SM.sample_fraction(rows, "row_id", 0.35, 7))  # drawn by key, then scored
    rows = s.select(*KEYS, "rts", "rtp", "rts_pred", "rtp_pred", *ML_PROTECTED, "draw")
    b = SM.assign_batches(rows, ["draw", *KEYS], 100)
    targets = [fz.Target("RTS", "rts", "rts_pred"), fz.Target("RTP", "rtp", "rtp_pred")]
    rep = fz.fairness_report(b, targets, ML_PROTECTED, 0.10, ["batch"])
    return finish(fz.batch_summary(rep))


@register("monitor_model", "FAIR-6 (boosting)")
def q_monitor_model(spark, sf):
    return _monitor(spark, sf, "gbt")


@register("monitor_model_holdout", "FAIR-6 (boosting, rows held out)")
def q_monitor_model_holdout(spark, sf):
    return _monitor(spark, sf, "gbt", "test")


@register("monitor_model_rf", "FAIR-6 (forest)")
def q_monitor_model_rf(spark, sf):
    return _monitor(spark, sf, "rf")
