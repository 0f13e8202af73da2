"""CSV source (encoding retry, NA spellings, extension check), history sinks, windows."""

import pytest
from pyspark.sql import functions as F

from equiwatch.sources import csv as CSV
from equiwatch.sources import sinks as SK


def test_latin1_retry_and_na(spark, tmp_path):
    p = tmp_path / "people.csv"
    p.write_bytes("name,age,city\nJosé,31,NA\nAnn,,Köln\nBob,40,null\n".encode("latin-1"))
    df = CSV.read_csv_infer(spark, str(p))
    rows = sorted((r["name"], r["age"], r["city"]) for r in df.collect())
    assert rows == [("Ann", None, "Köln"), ("Bob", 40, None), ("José", 31, None)]


def test_utf8_stays_utf8(spark, tmp_path):
    p = tmp_path / "u.CSV"
    p.write_bytes("name\nJosé\n".encode("utf-8"))
    assert CSV.read_csv_infer(spark, str(p)).first()["name"] == "José"


def test_unsupported_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        CSV.read_csv_infer(spark, str(tmp_path / "data.xlsx"))


def test_history_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 0.2, False), (2, 0.3, 0.1, True)],
                               "batch long, max_dp_diff double, max_eo_diff double, alert boolean")
    path = str(tmp_path / "hist")
    SK.append_history(df, path, "007", epoch=1)
    SK.append_history(df, path, "007", epoch=1)
    SK.append_history(df.where("batch = 1"), path, "1e3", epoch=2)
    h = SK.read_history(spark, path)
    assert h.count() == 3 and dict(h.dtypes)["batch"] == "bigint" and dict(h.dtypes)["epoch"] == "bigint"
    assert sorted(r["run_id"] for r in h.collect()) == ["007", "007", "1e3"]


def test_history_export_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 0.2, False, "x")],
                               "batch long, max_dp_diff double, max_eo_diff double, alert boolean, extra string")
    path = str(tmp_path / "h.csv")
    SK.export_history_csv(df, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["batch", "max_dp_diff", "max_eo_diff", "alert"]


def test_window_report_min_group(spark):
    from equiwatch.operators import fairness as fz
    rows = [("a", 1, 1)] * 5 + [("b", 1, 0)] * 5 + [("c", 0, 1)]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    t = [fz.Target("T", "y", "p")]
    full = fz.fairness_report(df, t, ["g"]).first()
    small_out = fz.fairness_report(df, t, ["g"], min_group_n=2).first()
    assert full["n_groups"] == 3 and small_out["n_groups"] == 2
    assert small_out["dp_diff"] == 1.0


def test_stream_windows_equal_batch_closed_windows(spark):
    from equiwatch.plans.q_streaming import window_stream_counts
    from equiwatch.plans.views import EVENTS_PROTECTED, events_scored
    from equiwatch.streaming import monitor as SM
    sf = "/root/testdata/sf0.001"
    stream = SM.report_from_window_counts(window_stream_counts(spark, sf))
    batch = SM.fairness_window(events_scored(spark, sf), "ts", "1 day", protected=EVENTS_PROTECTED)
    closed = [r["window_start"] for r in stream.select("window_start").distinct().collect()]
    assert closed
    key = ["window_start", "target", "attribute"]
    a = sorted(tuple(r) for r in stream.select(*key, "dp_diff", "eo_diff").collect())
    b = sorted(tuple(r) for r in batch.where(F.col("window_start").isin(closed))
               .select(*key, "dp_diff", "eo_diff").collect())
    assert a == b



def test_na_text_does_not_block_numeric_types(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("a,b,c\n1,2.5,x\nNA,null,y\n3,N/A,z\n")
    df = CSV.read_csv_infer(spark, str(p))
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "string"
    rows = {r["c"]: (r["a"], r["b"]) for r in df.collect()}
    assert rows == {"x": (1, 2.5), "y": (None, None), "z": (3, None)}


def test_quoted_cells_and_replacement_characters(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,t\n1,"he said ""hi"", ok"\n2,"two\nlines"\n3,Jos\u00e9 \ufffd\n', encoding="utf-8")
    df = CSV.read_csv_infer(spark, str(p))
    assert sorted((r["id"], r["t"]) for r in df.collect()) == [(1, 'he said "hi", ok'), (2, "two\nlines"), (3, "Jos\u00e9 \ufffd")]
    bad = tmp_path / "h.csv"
    bad.write_bytes("gr\u00f6\u00dfe\n1\n".encode("latin-1"))  # the only bad bytes are in the header
    assert CSV.read_csv_infer(spark, str(bad)).columns == ["gr\u00f6\u00dfe"]


def test_csv_is_split_unless_a_cell_holds_a_line_end(spark, tmp_path):
    plain, spanning = tmp_path / "plain.csv", tmp_path / "spanning.csv"
    plain.write_text('a,b\n1,"x ""y"" z"\n2,"q"\n')
    spanning.write_text('a,b\n1,"x\ny"\n2,"q"\n')
    assert CSV.raw_facts(spark, str(plain)) == (True, False)
    assert CSV.raw_facts(spark, str(spanning)) == (True, True)
    assert [tuple(r) for r in CSV.read_csv_infer(spark, str(plain)).collect()] == [(1, 'x "y" z'), (2, "q")]
    assert [tuple(r) for r in CSV.read_csv_infer(spark, str(spanning)).collect()] == [(1, "x\ny"), (2, "q")]
    (tmp_path / "none.csv").write_text("")
    assert CSV.raw_facts(spark, str(tmp_path / "none.csv")) == (True, False)
