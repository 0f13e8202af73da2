"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each whole text (shares of characters, lengths, repetition).
2. A small random forest on labelled texts; every path from a root to a node is
   a conjunctive rule over the statistics.
3. A lasso logistic regression on the rules' 0/1 values keeps a few of them.
4. The kept rules and weights are compiled into one Spark column expression.

The fit uses a bounded number of labelled rows (``MAX_LABELLED`` per class) and
is done by Spark's own learners; statistics and scores cover every text.

Defined cases: null and empty texts have statistics 0 and get the score of that;
repeated rows score alike; labels that are null or disagree are left out; with
labels of one class, or none, the score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import materialize
from .arrowtext import chunks, shingle_hashes, tidy, with_text_column, word_bounds, word_hashes
from .labelled import held_out, training_ids

MAX_LABELLED = 6000
THRESHOLD = 0.3
STATS = ("log_bytes", "log_words", "word_bytes", "upper_share", "symbol_share", "bang_share", "pipe_share",
         "digit_share", "blank_share", "line_bytes", "distinct_words", "distinct_pairs", "repeated_next",
         "short_words")
_SYMBOLS = b"#$%&*@^~+=<>\\/"


def _share(name: str) -> np.ndarray:
    table = np.zeros(256, bool)
    if name == "upper":
        table[65:91] = True
    elif name == "letter":
        table[65:91] = table[97:123] = True
    elif name == "digit":
        table[48:58] = True
    elif name == "blank":
        table[[9, 10, 11, 12, 13, 32]] = True
    else:
        table[np.frombuffer({"symbol": _SYMBOLS, "bang": b"!?", "pipe": b"|", "line": b"\n"}[name], np.uint8)] = True
    return table


_TABLES = {k: _share(k) for k in ("upper", "letter", "digit", "blank", "symbol", "bang", "pipe", "line")}


def text_stats(column: pa.Array) -> np.ndarray:
    """One row of ``STATS`` per text."""
    out = np.zeros((len(column), len(STATS)))
    for lo, hi, data, offsets in chunks(column):
        size = np.diff(offsets).astype(float)
        count = {}
        for name, table in _TABLES.items():
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            count[name] = (total[offsets[1:]] - total[offsets[:-1]]).astype(float)
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        pairs, pair_first = shingle_hashes(words, first, 2)
        n = np.diff(first).astype(float)
        length = np.concatenate(([0], np.cumsum(ends - starts)))
        short = np.concatenate(([0], np.cumsum(ends - starts <= 2)))
        same = np.zeros(len(words) + 1, np.int64)
        if len(words):
            same[1:-1] = np.cumsum(words[1:] == words[:-1])
            same[-1] = same[-2]
        distinct = np.array([[len(np.unique(words[a:b])), len(np.unique(pairs[c:d]))] for a, b, c, d in
                             zip(first[:-1], first[1:], pair_first[:-1], pair_first[1:], strict=True)], float)
        bytes_, per_word = np.maximum(size, 1), np.maximum(n, 1)
        inner = np.maximum(first[1:] - 1, first[:-1])  # a pair may not reach into the next text
        out[lo:hi] = np.column_stack([
            np.log1p(size), np.log1p(n), (length[first[1:]] - length[first[:-1]]) / per_word,
            count["upper"] / np.maximum(count["letter"], 1), count["symbol"] / bytes_, count["bang"] / bytes_,
            count["pipe"] / bytes_, count["digit"] / bytes_, count["blank"] / bytes_, size / (count["line"] + 1),
            distinct[:, 0] / per_word, distinct[:, 1] / np.maximum(n - 1, 1),
            (same[inner] - same[first[:-1]]) / np.maximum(n - 1, 1), (short[first[1:]] - short[first[:-1]]) / per_word])
    return out


def with_stats(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and a struct ``_ew_stats``; the text itself goes to Python once."""
    keep = list(docs.columns if keep is None else keep)
    stats = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])
    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)),
                           T.StructField("_ew_stats", stats)])

    def run(batches):
        for b in batches:
            values = text_stats(b.column(at))
            struct = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], struct], names=[f.name for f in schema])

    rows, at = with_text_column(docs, text, keep)
    rows = rows.mapInArrow(tidy(run), schema)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "_ew_stats")


#: A rule: (statistic, "<=" or ">", threshold) joined by "and".
Rule = tuple[tuple[str, str, float], ...]
_NODE = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)")


def tree_rules(description: str) -> set[Rule]:
    """Every path from a root to a node in a learner's printed trees."""
    rules, path = set(), []
    for line in description.splitlines():
        m = _NODE.match(line)
        if m is None:
            continue
        if "Tree" in line:
            path = []
        depth, condition = len(m[1]), (STATS[int(m[3])], m[4], float(m[5]))
        path = [p for p in path if p[0] < depth] + [(depth, condition)]
        rules.add(tuple(sorted(c for _, c in path)))
    return rules


def rule_column(rule: Rule) -> Column:
    """1.0 where all conditions hold, else 0.0."""
    out = None
    for name, op, value in rule:
        stat = F.col(f"_ew_stats.{name}")
        test = stat <= F.lit(value) if op == "<=" else stat > F.lit(value)
        out = test if out is None else out & test
    return out.cast("double")


@dataclass
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """The compiled ensemble: a probability from ``_ew_stats``."""
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.lit(weight) * rule_column(rule)
        return 1.0 / (1.0 + F.exp(-z))


def fit_rules(rows: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 2e-3, seed: int = 11) -> RuleModel:
    """Fit on ``label`` (0/1) and ``_ew_stats`` of a bounded sample."""
    features = array_to_vector(F.array(*[F.col(f"_ew_stats.{s}") for s in STATS]))
    train = materialize(rows.select(F.col("label").cast("double").alias("label"), "_ew_stats",
                                    features.alias("features")).coalesce(4))
    n, share = train.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        odds = min(max(float(share or 0.0), 1e-9), 1 - 1e-9)
        return RuleModel(float(np.log(odds / (1 - odds))), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed,
                                    featureSubsetStrategy="onethird").fit(train)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), ())
    values = train.select("label", array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("rules"))
    fit = LogisticRegression(featuresCol="rules", regParam=lasso, elasticNetParam=1.0, standardization=False,
                             maxIter=40).fit(materialize(values))
    kept = tuple((float(w), r) for w, r in zip(fit.coefficients.toArray(), rules, strict=True) if w != 0.0)
    return RuleModel(float(fit.intercept), kept)


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``_ew_stats`` and ``label`` of the bounded sample of labelled documents."""
    ids = training_ids(labels, label, {0: MAX_LABELLED, 1: MAX_LABELLED})
    sample = docs.join(F.broadcast(ids), "doc_id").select("label", "text")  # at most 2 x MAX_LABELLED ids
    return with_stats(sample, keep=["label"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    return fit_rules(labelled_stats(docs.select("doc_id", "text"), labels))


def reject_low_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, in the columns they came in."""
    return with_stats(docs).where(model.score() >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Score every document; labels are learned outside the held-out fold only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_stats(docs.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
