"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source asks for a share of the total in proportion to its weight.  A
source whose share exceeds ``max_epochs`` times its own size is clamped there
and its excess is shared among the others by weight, until none is above.

A source's target is then met by repetitions: every document is taken
``floor(target / size of source)`` whole times, and one more whole repetition
goes to documents in the order of a seeded hash until the rest is used up.  The
documents of the one hash bucket where that happens take a fractional
repetition (their first words), so the words taken are within one word per such
document of the target.

Defined cases: a null source is a source like any other, weighed last where
weights are given by rank; a null or negative size counts as 0; a source or
table of size 0 has target 0; repeated rows are documents of their own (they
share their draw); columns named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import materialize
from .linededup import written

#: Hash buckets per source (three hex digits of an md5): one of them is split.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken")


def text_size(text: str = "text") -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating over sources by code point, null last (one row per source)."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    return sources.select(source, ((place - 1) % cycle + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row per source with ``words`` and ``weight``.

    Each round is one aggregate over the sources that were not clamped so far;
    a round clamps at least one source or ends.
    """
    cap = F.col("words") * F.lit(float(max_epochs))
    total = float(sources.agg(F.sum("words")).first()[0] or 0)
    level = 0.0
    clamped_before = -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        n, used, weight = sources.agg(
            F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped_before or not weight:
            break
        clamped_before, level = n, max(level, (total - float(used or 0)) / float(weight))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, size: str = "size", source: str = "source",
                key: str = "doc_id", max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    ``weights``: one row per source (``source``, ``weight``); by default 1, 2, 3
    repeating over the sources by code point.
    """
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))),
                       1, BUCKET_DIGITS)
    own_size = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    rows = docs.withColumn("_mix_size", own_size).withColumn("_mix_draw", draw)
    buckets = materialize(rows.groupBy(F.col(source).alias("_mix_source"), "_mix_draw")
                          .agg(F.sum("_mix_size").alias("words")))
    sources = buckets.groupBy("_mix_source").agg(F.sum("words").alias("words"))
    if weights is None:
        weights = ranked_weights(sources.select("_mix_source"), "_mix_source")
    else:
        weights = weights.select(F.col(source).alias("_mix_source"), F.col("weight").cast("double"))
    w = weights.withColumnRenamed("_mix_source", "_mix_w_source")
    sources = sources.join(w, F.col("_mix_source").eqNullSafe(F.col("_mix_w_source")), "left").select(
        "_mix_source", "words", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    plan = (water_fill(materialize(sources), max_epochs)
            .withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("words"))
            .select(F.col("_mix_source").alias("_mix_s"), F.col("words").alias("source_size"), "target", "whole", "rest"))
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("_mix_source").orderBy("_mix_draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Buckets before the one where the rest is used up go in whole, those after it not at all.
    cut = F.min(F.when((F.col("words") > 0) & (F.col("_before") + F.col("words") > F.col("rest")), F.struct(
        F.col("_mix_draw").alias("draw"),
        F.try_divide(F.col("rest") - F.col("_before"), F.col("words")).alias("part"))))
    split = written(buckets.withColumn("_before", before)
                    .join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_s")))
                    .groupBy("_mix_s", F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"),
                             F.col("whole").alias("_mix_whole")).agg(cut.alias("_mix_cut")), "mix")
    n, place = F.col("_mix_size"), F.col("_mix_draw")
    part = (F.when(F.col("_mix_cut").isNull() | (place < F.col("_mix_cut.draw")), 1.0)
            .when(place == F.col("_mix_cut.draw"), F.greatest(F.lit(0.0), F.col("_mix_cut.part"))).otherwise(0.0))
    taken = F.when(n > 0, (F.col("_mix_whole") * n + F.floor(n * part)).cast("long")).otherwise(F.lit(0).cast("long"))
    joined = rows.join(split, F.col(source).eqNullSafe(F.col("_mix_s")))  # one row a source
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    return joined.select(*kept, n.alias("size"), F.col("_mix_total").cast("long").alias("source_size"),
                         F.col("_mix_target").alias("target"), taken.alias("taken"))


def repeated_texts(mix: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as it is taken, with ``repetition`` (from 1) and ``words``.

    Whole repetitions hold the whole text.  A fractional one comes last and holds the
    text up to the end of its first ``words`` words.  Rows that take nothing are not in it.
    """
    n, taken = F.col("size"), F.col("taken")
    times = F.sequence(F.lit(1).cast("long"), F.ceil(taken / n))
    rows = mix.where((n > 0) & (taken > 0)).withColumn("repetition", F.explode(times))
    words = F.least(n, taken - (F.col("repetition") - 1) * n)
    own = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(own, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.when(F.col("words") == n, own).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    kept = [F.col(f"`{c}`") for c in mix.columns if c not in (text, "words", "repetition")]
    return rows.withColumn("words", words.cast("long")).select(*kept, cut.alias(text), "repetition", "words")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 1, 2, 3 repeating, at most 3 epochs of any source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialize(docs.select("doc_id", "source", text_size().alias("size")))
    return mix_sources(rows).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(concat('7:', COALESCE(doc_id::VARCHAR, ''))), 1, 3) AS draw
  FROM documents),
buckets AS (SELECT source, draw, SUM(size)::BIGINT AS words FROM rows GROUP BY source, draw),
sources AS (
  SELECT source, words, ((ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1.0::DOUBLE AS weight,
         words * 3.0::DOUBLE AS cap
  FROM (SELECT source, SUM(words)::BIGINT AS words FROM buckets GROUP BY source)),
ordered AS (
  SELECT *, cap / weight AS breaks,
         COALESCE(SUM(cap) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         SUM(weight) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         SUM(words) OVER () AS total
  FROM sources),
level AS (SELECT COALESCE(arg_min((total - used) / open, used), 0) AS level FROM ordered WHERE (total - used) / open <= breaks),
plan AS (
  SELECT source, words AS source_size, LEAST(cap, weight * level) AS target,
         CASE WHEN words > 0 THEN FLOOR(LEAST(cap, weight * level) / words)::BIGINT ELSE 0 END AS whole
  FROM sources, level),
parts AS (
  SELECT b.source, b.draw, p.source_size, p.target, p.whole,
         CASE WHEN b.words > 0 THEN LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, ((p.target - p.whole * p.source_size)
           - COALESCE(SUM(b.words) OVER (PARTITION BY b.source ORDER BY b.draw
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / b.words)) ELSE 0.0::DOUBLE END AS part
  FROM buckets b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT r.doc_id, r.size, p.source_size::BIGINT AS source_size, p.target::DOUBLE AS target,
       (p.whole * r.size + FLOOR(r.size * p.part))::BIGINT AS taken
FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source AND r.draw = p.draw
"""
