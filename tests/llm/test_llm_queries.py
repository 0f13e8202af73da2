"""Registered queries of the subpackage against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline as P
from equiwatch.llm.queries import QUERIES, SQL
from equiwatch.llm.quality import THRESHOLD, fit_quality, with_stats

from .helpers import empty_docs, odd_docs
from .test_text_operators import brute_classes, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert "pipeline" in QUERIES


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        frames[name] = (docs, out)
        if name != "mixing":
            assert out.columns == columns
        docs = out
    before, after = frames["quality"]
    model = fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r[0] for r in with_stats(before).where(model.score() >= THRESHOLD).select("doc_id").collect()}
    assert {r["doc_id"] for r in after.collect()} == good
    before, after = frames["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    _, classes = brute_classes(rows)
    assert {r["doc_id"] for r in after.collect()} == {min(c) for c in classes.values()}
    before, after = frames["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items)[1]}
    assert {r["doc_id"] for r in after.collect()} == clean
    before, after = frames["mixing"]
    taken = after.groupBy("source").agg({"words": "sum", "target": "max"}).collect()
    assert sum(len(r["text"].split()) - r["words"] for r in after.collect()) == 0
    assert all(abs(r[1] - r[2]) <= 0.05 * r[2] + 50 or abs(r[2] - r[1]) <= 0.05 * r[1] + 50 for r in taken)


def test_line_stage_drops_planted_lines_in_every_source(spark):
    rows, planted = [], "Subscribe to our letter and never miss a word."
    for s in range(3):
        for k in range(400):
            lines = [f"line {k} of source {s}", "on five pages" if k < 5 else f"more of {k}", *([planted] if k % 30 == s else [])]
            rows.append((len(rows), "\n".join(lines), f"s{s}"))
        rows += [(len(rows) + i, f"copied page of source {s}\nwith its own end", f"s{s}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, SF).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x != planted) for i, t, _ in rows}


def test_line_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    line = "The and attion to thanedble the, anea."
    held = docs.where(docs.text.contains("\n" + line))
    assert held.select("source").distinct().count() == 20
    out = P.line_dedup(spark, docs, SF).cache()
    assert not any(x.strip().startswith(line) for r in out.where(out.text.contains(line)).collect() for x in r["text"].split("\n"))
    assert out.where("trim(text) = ''").count() == docs.where("trim(text) = ''").count()


def test_stages_on_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "mixing":
            assert set(docs.columns) - set(out.columns) == set()
            assert out.where("text IS NULL OR words <= 0").count() == 0
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out


def test_stages_on_an_empty_table(spark):
    for name, stage in P.STAGES:
        if name != "quality":  # its model is fitted on the documents
            assert stage(spark, empty_docs(spark), SF).count() == 0
