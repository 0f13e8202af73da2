"""URL filters: host and path rules, and a logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits that host and its
subdomains, and the longest fitting rule decides.  All other urls are judged by
a logistic regression on hashed character n-grams of host and path, fitted on a
small labelled table of urls.  There is no such table among the given ones: the
registered query takes as labels what the rules say of urls that one fits, so its
model carries the rules over to hosts that none names.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule fits it, and the model judges it (by its intercept alone); repeated rows
are judged alike; an empty labelled table, or one of a single class, makes a
constant verdict (``allow`` if it is empty).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host, start of path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled urls the model is fitted on, at most.
MAX_LABELLED = 5000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer ones decide over shorter ones
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column, sizes: Sequence[int] = (3, 4)) -> Column:
    """Character n-grams of host and of path, marked by where they are from."""
    def cut(text: Column, mark: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n)))),
                          F.array().cast("array<string>"))
    return F.concat(*[cut(t, m, n) for t, m in ((host, "h"), (path, "p")) for n in sizes])


@dataclass
class UrlModel:
    model: LogisticRegressionModel | None
    constant: float
    features: int

    def score(self, urls: DataFrame, grams: str, out: str) -> DataFrame:
        """Add the probability that a url is to be blocked."""
        if self.model is None:
            return urls.withColumn(out, F.lit(self.constant))
        hashed = HashingTF(numFeatures=self.features, binary=True, inputCol=grams, outputCol="_ew_features")
        scored = self.model.copy().setFeaturesCol("_ew_features").setProbabilityCol("_ew_probability") \
            .setPredictionCol("").setRawPredictionCol("").transform(hashed.transform(urls))
        from pyspark.ml.functions import vector_to_array
        return scored.withColumn(out, vector_to_array("_ew_probability")[1]).drop("_ew_features", "_ew_probability")


def fit_url_model(labelled: DataFrame, features: int = 1 << 12, reg: float = 1e-3, rounds: int = 25) -> UrlModel:
    """Fit on ``url`` and ``blocked`` (0/1), a small table; rows with a null label are left out."""
    rows = (labelled.where(F.col("blocked").isNotNull()).withColumn("_ew_h", host_of(F.col("url")))
            .withColumn("_ew_p", path_of(F.col("url"))).withColumn("_ew_grams", ngrams(F.col("_ew_h"), F.col("_ew_p"))))
    hashed = HashingTF(numFeatures=features, binary=True, inputCol="_ew_grams", outputCol="features").transform(rows)
    train = materialize(hashed.select("features", F.col("blocked").cast("double").alias("label")).coalesce(2))
    n, share = train.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return UrlModel(None, float(share or 0.0), features)
    fit = LogisticRegression(regParam=reg, maxIter=rounds, standardization=False).fit(train)
    return UrlModel(fit, float(share), features)


def judge_urls(pages: DataFrame, model: UrlModel, url: str = "url",
               rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (probability of block); same-named columns are replaced."""
    added = ("host", "path", "rule", "verdict", "score")
    kept = [f"`{c}`" for c in pages.columns if c not in added]
    rows = pages.withColumn("_ew_url", F.col(f"`{url}`")).select(
        *kept, host_of(F.col("_ew_url")).alias("host"), path_of(F.col("_ew_url")).alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    scored = model.score(rows.withColumn("_ew_grams", ngrams(F.col("host"), F.col("path"))), "_ew_grams", "score")
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "score")


def rule_labelled(pages: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The small labelled table of the registered query: ``limit`` distinct urls that a rule decides, chosen by hash."""
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    _, says = longest_rule(host_of(F.col("url")), path_of(F.col("url")))
    return (urls.select("url", (says == "block").cast("int").alias("blocked")).where(says.isNotNull())
            .orderBy(F.md5("url"), "url").limit(limit))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every page's url by the rules, and by the model where no rule fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, fit_url_model(rule_labelled(pages))).select("page_id", "host", "path", "rule", "verdict",
                                                                         "score")
