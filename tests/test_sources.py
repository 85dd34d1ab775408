import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthloom.sources import sinks, tables
from monthloom.streaming import monthly


def test_pipe_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" Airport Code | Airport Name \n XNV | Some Field \n| x \n")
    (tmp_path / "skip_b.txt").write_text("h|h\nno|no\n")
    rows = tables.csv(spark, str(tmp_path), "code string, name string", sep="|", skip="skip*").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("XNV", "Some Field"), (None, "x")]


def test_legacy_encoding(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("acronym,full\nb,caf\x82\n".encode("latin-1"))
    assert tables.csv(spark, str(tmp_path / "d.csv"), "acronym string, full string", encoding="IBM437").first().full == "café"


def test_second_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("g1,g1,g2\na,b,c\n1,2,3\n4,x,\n")
    assert [tuple(r) for r in tables.csv_second_header(spark, str(tmp_path / "t.csv"), "a int, b int, c string").collect()] == [(1, 2, "3"), (4, None, None)]


def test_link_words(spark):
    html = "<table><td><a href='x'>Skip</a></td><td><a>New York</a></td> <td><a>Los Angeles</a></td><td><a>End</a></td>"
    df = spark.createDataFrame([(html,), (None,), ("<td>none",)], "html string")
    assert {r.word for r in tables.link_words(df, "html", "New York", "Los Angeles").collect()} == {"new", "york", "los", "angeles"}


def test_ragged_groups(spark):
    cells = [(0, None, "happy"), (1, "affect", "sad"), (2, "time", "now"), (3, None, "lost"), (1, "affect", None), (2, "time", "")]
    got = {tuple(r) for r in tables.ragged_groups(spark.createDataFrame(cells, "col_idx int, header string, word string")).collect()}
    assert got == {("affect", "happy"), ("time", "sad")}  # a header names the columns before it, from the last header on


def test_dictionaries(spark):
    df = spark.createDataFrame([(1, " AB ", "Alpha (x)"), (2, "AB", "Beta"), (3, None, "n"), (4, "C", None)], "o int, a string, f string")
    one = tables.dictionary(df, "casa", "a", "f", "o", strip_parens=True, first_only=True)
    assert [tuple(r) for r in one.collect()] == [("casa", "ab", "Alpha")]
    assert tables.dictionary(df, "iata", "a", "f").count() == 2


def test_annotations(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "b", None, None), (3, "c", None, "y"), (4, "d", None, None)], "o int, w string, f string, g string")
    assert {r.word for r in tables.flagged_words(df, "w", "f").collect()} == {"a"}
    assert [r.w for r in tables.after_last_flag(df, "o", "w", ["f", "g"]).collect()] == ["d"]


def test_volumes(spark):
    df = spark.createDataFrame([("A", "1,234"), ("B", "x")], "k string, n string")
    assert [r.n for r in tables.volume_report(df, ["n"]).collect()] == [1234, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    sinks.write_table(df, str(tmp_path / "p"), by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and (tmp_path / "p/k=a").exists()
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert tables.csv(spark, str(tmp_path / "c"), "k string, v int").count() == 3
    rest = sinks.quarantine(df, F.col("k") == "a", str(tmp_path / "bad"))
    assert sorted(r.v for r in rest.collect()) == [2, 3] and spark.read.parquet(str(tmp_path / "bad")).count() == 1


@pytest.mark.parametrize("n", [20])
def test_stream_equals_batch(spark, tmp_path, n):
    rows = [(i % 3, dt.datetime(2024, 1, 1 + i // 4, i)) for i in range(n)]
    df = spark.createDataFrame(rows, "entity int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r.entity, r.window_start): r.n_events for r in monthly.windowed_counts(df, "entity", "ts").collect()}
    stream = monthly.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "entity", "ts", late="0 seconds")
    monthly.run_once(spark, stream, str(tmp_path / "out"), str(tmp_path / "chk"))
    out = {(r.entity, r.window_start): r.n_events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out and out.items() <= batch.items()
    assert len(batch) - len(out) <= 3  # the last day isn't complete yet
