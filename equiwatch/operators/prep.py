"""Feature preparation fitted on training rows, applied as a pure projection.

* numeric columns: median imputation, then standardisation with the
  *population* standard deviation (zero → 1);
* text columns: most-frequent imputation (ties → smallest value), then a sparse
  0/1 vector over the training categories in sorted order (unseen → all zeros);
* NaN/±inf → 0 in the final matrix.

Fitting is a handful of aggregates (medians; means/std of the imputed values;
one grouped count for all text columns at once).  The fitted constants are
written into a ``SQLTransformer`` statement, followed by Spark's own indexer,
one-hot encoder and assembler, so the result is an ordinary, saveable ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import global_rank


def _c(name: str):
    return F.col(f"`{name}`")


def medians(df: DataFrame, cols: Sequence[str], method: str = "exact") -> dict[str, float | None]:
    """Exact medians (even counts average the middle pair), all columns at once."""
    if not cols:
        return {}
    from .labels import percentiles
    row = percentiles(df, {f"m{i}": (_c(c).cast("double"), 0.5) for i, c in enumerate(cols)}, method).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute_median(df: DataFrame, med: dict[str, float | None]) -> DataFrame:
    keep = {c: v for c, v in med.items() if v is not None}
    return df.select(*[F.coalesce(_c(f.name).cast("double"), F.lit(keep[f.name])).alias(f.name)
                       if f.name in keep else _c(f.name) for f in df.schema.fields])


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (std 0 or undefined → 1)."""
    if not cols:
        return {}
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(_c(c)).alias(f"a{i}"), F.stddev_pop(_c(c)).alias(f"s{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        out[c] = (row[f"a{i}"] or 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def standardize(df: DataFrame, mom: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((_c(f.name) - F.lit(mom[f.name][0])) / F.lit(mom[f.name][1])).alias(f.name)
                       if f.name in mom else _c(f.name) for f in df.schema.fields])


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count, rank=1) — the most frequent value per text column,
    ties to the smallest value.  Aggregates only (no window over a column's
    values, so a high-cardinality column never lands in one task): counts per
    (column, value), the top count per column, then the smallest value at it."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
                                         for c in cols])).alias("_cv")).select("_cv.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    top = counts.groupBy("column").agg(F.max("count").alias("count"))
    best = counts.join(top, ["column", "count"]).groupBy("column", "count").agg(F.min("value").alias("value"))
    return best.select("column", "value", "count", F.lit(1).alias("rank"))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    if not cols:
        return {}
    rows = mode_table(df, cols).where("rank = 1").collect()
    found = {r["column"]: r["value"] for r in rows}
    return {c: found.get(c) for c in cols}


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct training values per text column (after mode imputation)."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
                                         for c in cols])).alias("_cv")).select("_cv.*").where("value IS NOT NULL")
    distinct = long.distinct()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in distinct.collect():
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_exprs(col: str, cats: Sequence[str], fill: str | None):
    v = F.coalesce(_c(col).cast("string"), F.lit(fill)) if fill is not None else _c(col).cast("string")
    return [F.when(v == F.lit(k), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{col}_{k}") for k in cats]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


@dataclass
class PrepModel:
    """The fitted preparation: constants, feature names and the pipeline."""

    numeric: list[str]
    categorical: list[str]
    medians: dict
    moments: dict
    modes: dict
    categories: dict
    feature_names: list[str]
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def transform_vector_only(self, df: DataFrame) -> DataFrame:
        """The input columns plus the feature vector."""
        return self.transform(df).drop(*self.made_columns())

    def made_columns(self) -> list[str]:
        """Columns that ``transform`` adds beside the vector."""
        texts = [f"txt__{c}" for c in self.categorical]
        return [f"num__{c}" for c in self.numeric] + [t + end for t in texts for end in ("", "__index", "__hot")]


def one_hot_model(train: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """Sparse 0/1 vectors ``<col>__hot`` over the sorted training values (unseen and missing → all zeros).

    Any number of values: a row holds one slot, and no column is made per value.
    """
    index = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__index" for c in cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}__index" for c in cols], outputCols=[f"{c}__hot" for c in cols],
                        dropLast=True)  # the last slot is the indexer's one for unseen values
    return Pipeline(stages=[index, hot]).fit(train)


def category_slots(train: DataFrame, col: str) -> DataFrame:
    """(value, slot) of every training value in sorted order, slots from 0: a table, ranked without a driver or one task."""
    values = train.select(_c(col).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return global_rank(values, ["value"], out="slot").select("value", (F.col("slot") - 1).alias("slot"))


def with_slot(df: DataFrame, col: str, slots: DataFrame, out: str | None = None) -> DataFrame:
    """``df`` with the slot of the row's value (NULL where it is missing or unseen): the one entry of its 0/1 vector.

    A plain join; a value held by a third of the rows is a skewed key, which adaptive execution splits.
    """
    known = slots.select(F.col("value").alias("_ew_value"), F.col("slot").alias("_ew_slot"))
    joined = df.join(known, _c(col).cast("string") == F.col("_ew_value"), "left")
    return joined.select(*[_c(c) for c in df.columns], F.col("_ew_slot").alias(out or f"{col}__slot"))


def hot_slot(vector: str):
    """The slot of a one-hot vector, NULL if it has none."""
    values = vector_to_array(F.col(vector))
    return F.when(F.array_contains(values, 1.0), (F.array_position(values, 1.0) - 1).cast("int"))


def vector_size(vector: str):
    return F.size(vector_to_array(F.col(vector)))


def prep_statement(numeric, categorical, med, mom, mode) -> tuple[str, list[str], list[str]]:
    """The projection before encoding: prepared numbers ``num__x`` and filled text ``txt__s``."""
    exprs, numbers, texts = [], [], []
    for c in numeric:
        x = f"CAST({_q(c)} AS DOUBLE)"
        if med.get(c) is not None:
            x = f"COALESCE({x}, {_lit(med[c])})"
        mean, std = mom.get(c, (0.0, 1.0))
        x = f"(({x} - {_lit(mean)}) / {_lit(std)})"
        x = f"(CASE WHEN isnan({x}) OR abs({x}) = double('inf') THEN 0.0 ELSE COALESCE({x}, 0.0) END)"
        numbers.append(f"num__{c}")
        exprs.append(f"{x} AS {_q(numbers[-1])}")
    for c in categorical:
        v = f"CAST({_q(c)} AS STRING)"
        if mode.get(c) is not None:
            v = f"COALESCE({v}, {_lit(mode[c])})"
        texts.append(f"txt__{c}")
        exprs.append(f"{v} AS {_q(texts[-1])}")
    return "SELECT *, " + ", ".join(exprs) + " FROM __THIS__", numbers, texts


def fit_prep(train: DataFrame, features: Sequence[str], output_col: str = "features") -> PrepModel:
    """Fit on training rows.  Text columns are categorical, everything numeric,
    boolean or already converted is numeric; other types are dropped."""
    fields = {f.name: f.dataType for f in train.schema.fields}
    numeric = [c for c in features if isinstance(fields[c], (T.NumericType, T.BooleanType))]
    categorical = [c for c in features if isinstance(fields[c], T.StringType)]
    sub = train.select(*[_c(c) for c in numeric + categorical])
    med = medians(sub, numeric)
    # A numeric column with no value in the training rows carries no feature.
    numeric = [c for c in numeric if med.get(c) is not None]
    mom = moments(impute_median(sub.select(*[_c(c) for c in numeric]), med), numeric) if numeric else {}
    mode = modes(sub, categorical)
    categorical = [c for c in categorical if mode.get(c) is not None]  # likewise
    statement, numbers, texts = prep_statement(numeric, categorical, med, mom, mode)
    first = SQLTransformer(statement=statement)
    stages, cats = [first], {}
    if texts:
        hot = one_hot_model(first.transform(train), texts)
        labels = hot.stages[0].labelsArray
        cats = {c: list(v) for c, v in zip(categorical, labels, strict=True)}
        stages += hot.stages
    # The numbers ``num__x`` stay next to the vector; the encoder records the
    # category of every slot in the vector's metadata.
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"{t}__hot" for t in texts]], outputCol=output_col))
    names = numbers + [f"cat__{c}_{k}" for c in categorical for k in cats[c]]
    return PrepModel(numeric, categorical, med, mom, mode, cats, names, PipelineModel(stages))
