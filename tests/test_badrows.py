import re

import pytest

from monthloom.operators import badrows as b

GOOD = " XNV | Some Airport | 31.5 | -97.8 | A, TX | 08/19/2014 | Accident "


def line(code="XNV", name="Some", lat="31"):
    return f"{code}|{name}|{lat}|-97|A, TX|08/19/2014|Accident"


CASES = [
    (GOOD, None), (line(code=""), None), (line(code=" n/a "), None), (line(code="NONE"), None), (line(code="AB"), "airport_code"), (line(code="ABCDE"), "airport_code"), (line(code="A B"), "airport_code"), (line(code="ÄBC"), "airport_code"),
    (line(lat=""), None), (line(lat="+38."), None), (line(lat="-90"), None), (line(lat="90.0"), None), (line(lat="90.1"), "latitude"), (line(lat="91"), "latitude"), (line(lat="31.98D"), "latitude"), (line(lat="1e1"), "latitude"), (line(lat="N/A"), "latitude"),
    (line(lat='" 43.8 "'), None), (line(lat="31.98D", code="ABCDE"), "latitude"), (line(name='"A|B"'), None), (line(name='"A ""old"" field" '), None), (line(name='"A'), "quoting"), (line(name='A "old"'), "quoting"), (line(name='"A" x'), "quoting"), (line(name='""'), None),
    (line() + "|x", "columns"), ("a|b", "columns"), ("", "columns"), (None, "columns"), ("|" * 6, None), ('"' * 3 + "|" * 9, "quoting"), (line(name="x" * 200_000), None), (line(name='"' + 'a""' * 60_000 + '"'), None), ("|" * 100_000, "columns"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "reason int, line string").withColumnRenamed("reason", "id")
    good, bad = b.split_rows(df, "line", b.REGISTER_B, ["latitude", "airport_code"])
    got = {r.id: r.reason for r in bad.collect()}
    assert [(str(t)[:60], w, got.get(i)) for i, (t, w) in enumerate(CASES) if got.get(i) != w] == []
    assert {r.id for r in good.select("id").collect()} == {i for i, (_, w) in enumerate(CASES) if w is None}


def test_values(spark):
    df = spark.createDataFrame([(' x1y |"A ""b""|c" | 5. |||  |"" ', "mine")], "line string, airport_code string")
    good, bad = b.split_rows(df, "line", b.REGISTER_B, ["latitude", "airport_code"])
    r = good.first()
    assert (r.airport_code, r.airport_code_parsed, r.airport_name, r.latitude, r.longitude, r.investigation_type) == ("mine", "x1y", 'A "b"|c', "5.", None, None)
    assert bad.count() == 0


def test_empty_table(spark):
    good, bad = b.split_rows(spark.createDataFrame([], "line string"), "line", b.REGISTER_B, ["latitude", "airport_code"])
    assert good.count() == bad.count() == 0


@pytest.mark.parametrize("v,ok", [("0", 1), ("089.5", 1), ("-0090.000", 1), (".5", 1), (".", 0), ("+", 0), ("90.000001", 0)])
def test_latitude_pattern(v, ok):
    assert bool(re.fullmatch(b.LATITUDE, v)) == bool(ok)
