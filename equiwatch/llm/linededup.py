"""Line dedup by site-relative frequency.

Within a host, a line is boilerplate if more than ``ratio`` of the host's pages
hold it (and at least ``min_pages`` pages do, so that a host of a few pages
keeps its lines).  A page counts a line once.  Lines are compared without blanks
at either end; blank lines are never counted or dropped.  With ``copies_once`` pages
of a host with the same text count as one, so that many copies of a page don't
make its own lines boilerplate.

A host has at most (mean lines per page) / ``ratio`` boilerplate lines, so their
digests travel as one small array per host; pages and lines are counted by
partial aggregates, which reduces a hot host before any shuffle.  The arrays are
written to the shared folder before texts meet them: Spark knows the table's size
then and moves no text where it is small enough to be broadcast.

Defined cases: a null host is a host of its own; a null text stays null and
counts as a page; an empty text has one blank line; repeated rows are pages of
their own; a text whose lines all go becomes empty, its row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, of a size that Spark knows when it plans a join."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int,
                copies_once: bool = False) -> DataFrame:
    """One row per host that has boilerplate: ``_ew_host`` and the digests of its lines."""
    own_text, own_host = F.col(f"`{text}`"), F.col(f"`{host}`")
    own = F.array_distinct(F.transform(_lines(own_text), _stripped))
    page = [F.xxhash64(own_text).alias("_ew_page")] if copies_once else []
    lines = (docs.select(own_host.alias("_ew_host"), *page, F.explode(own).alias("_ew_line"))
             .where(F.col("_ew_line") != "")
             .withColumn("_ew_digest", F.md5("_ew_line")).drop("_ew_line"))
    sites = docs.select(own_host.alias("_ew_site"), *page)
    if copies_once:
        lines, sites = lines.distinct(), sites.distinct()
    counts = lines.groupBy("_ew_host", "_ew_digest").agg(F.count(F.lit(1)).alias("_ew_n")).where(F.col("_ew_n") >= min_pages)
    pages = sites.groupBy("_ew_site").agg(F.count(F.lit(1)).alias("_ew_pages"))
    return (counts.join(pages, F.col("_ew_host").eqNullSafe(F.col("_ew_site")))
            .where(F.col("_ew_n") > F.lit(ratio) * F.col("_ew_pages"))
            .groupBy("_ew_host").agg(F.collect_list("_ew_digest").alias("_ew_common")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", *, ratio: float = 0.1,
                     min_pages: int = 5, counts: bool = False, copies_once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``counts`` adds n_lines and n_dropped."""
    common = written(boilerplate(docs, host, text, ratio, min_pages, copies_once), "boilerplate")
    own_text = F.col(f"`{text}`")
    lines = _lines(own_text)
    kept = F.when(F.col("_ew_common").isNull(), lines).otherwise(F.filter(
        lines, lambda x: (_stripped(x) == "") | ~F.array_contains(F.col("_ew_common"), F.md5(_stripped(x)))))
    joined = docs.join(common, F.col(f"`{host}`").eqNullSafe(F.col("_ew_host")), "left")
    out = [F.when(F.col("_ew_common").isNull(), own_text).otherwise(F.array_join(kept, "\n")).alias(text)
           if c == text else F.col(f"`{c}`") for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        n = F.when(own_text.isNull(), F.lit(0)).otherwise(n).cast("long")
        left = F.when(own_text.isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
        out += [n.alias("n_lines"), (n - left).alias("n_dropped")]
    return joined.select(*out)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, a source being a site: lines on more than a tenth of its pages go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs.select("doc_id", "source", "text"), counts=True)


OP6_SQL = r"""
WITH own AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, ROW_NUMBER() OVER () AS row_no FROM documents),
stripped AS (
  SELECT DISTINCT row_no, source, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT row_no, source, unnest(lines) AS line FROM own)),
pages AS (SELECT source, COUNT(*) AS pages FROM documents GROUP BY source),
common AS (
  SELECT s.source, s.line FROM stripped s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.line <> '' GROUP BY s.source, s.line, p.pages HAVING COUNT(*) >= 5 AND COUNT(*) > 0.1::DOUBLE * p.pages),
sites AS (SELECT source, list(line) AS bad FROM common GROUP BY source),
kept AS (
  SELECT o.doc_id, o.source, o.text, o.lines,
         CASE WHEN s.bad IS NULL THEN o.lines ELSE list_filter(o.lines, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) = ''
              OR NOT list_contains(s.bad, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))) END AS kept
  FROM own o LEFT JOIN sites s ON o.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       COALESCE(len(lines), 0)::BIGINT AS n_lines, (COALESCE(len(lines), 0) - COALESCE(len(kept), 0))::BIGINT AS n_dropped
FROM kept
"""
