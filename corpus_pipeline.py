"""Corpus cleaning pipeline: quality rules, line dedup, near duplicates, decontamination, source mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns what its successor works
on: the columns of ``documents``, and in the end the mix itself, each document as often
as it is taken (``repetition``), the last time perhaps only its first ``words`` words.

* quality: documents that the rule ensemble scores under 0.3 go;
* lines: lines on more than a fiftieth of a source's different texts (5 at least) go, ``n_chars`` follows;
* near duplicates: one document of each class (5-word Jaccard of 0.8 or more) stays;
* decontamination: documents with a 10-word benchmark window go;
* mixing: sources weighed 1, 2, 3 repeating, 3 epochs at most; a document that
  takes no words is not in the mix.

Defined cases, of every stage: null and empty texts pass the first four (the rules may
reject them) and take no words in the mix; repeated rows are rows of their own but for
near duplicates, where one of a class stays, by least id; a null source is a source;
extra columns stay as they are, but for ``n_chars``, which follows the text, and those that
the mix adds (size, source_size, target, taken, repetition, words); an empty table
stays empty.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiwatch.llm.decontaminate import decontaminate
from equiwatch.llm.linededup import drop_boilerplate
from equiwatch.llm.mixing import mix_sources, repeated_texts, text_size
from equiwatch.llm.neardup import keep_one
from equiwatch.llm.quality import fit_quality, reject_low_quality
from equiwatch.session import scratch_path

#: A source is a whole site here: a line planted all over it is still on few of its documents.
LINE_RATIO = 0.02


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_low_quality(docs, fit_quality(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(docs, ratio=LINE_RATIO, copies_once=True)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_texts(mix_sources(docs.withColumn("size", text_size())))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]

#: The quality rules are fitted, so no SQL gives these rows; tests hold each stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(base, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
