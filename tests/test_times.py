import random
import zoneinfo
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from monthloom.operators import timestamps as ts

NY, CHI, HNL = "America/New_York", "America/Chicago", "Pacific/Honolulu"
CASES = [
    ("04-JAN-88", NY, "1988-01-04"), (" 24-JAN-88", NY, "1988-01-24"), ("3-Mar-77", NY, "2077-03-03"), ("29-FEB-99", NY, "INVALID"), ("14-XXX-94", NY, "INVALID"), ("03-JUN", NY, "INVALID"), ("10/19/", NY, "INVALID"),
    ("15 Jan 1988", NY, "1988-01-15"), ("13 Feb 1988 2204Z", NY, "1988-02-13T22:04:00Z"), ("Wed, 30 Mar 1988 04:20:50 -0600", NY, "1988-03-30T10:20:50Z"), ("18-FEB-1988 22:10:33 CST", NY, "1988-02-19T04:10:33Z"),
    ("January 18, 1988", NY, "1988-01-18"), ("February 14, 1988 7:10 pm PST", NY, "1988-02-15T03:10:00Z"), ("September 14, 1988 12:02 am MDT", NY, "1988-09-14T06:02:00Z"), ("02/17/1988 05:24 PM", NY, "1988-02-17T22:24:00Z"),
    ("03/04/1988 14:57 UTC", NY, "1988-03-04T14:57:00Z"), ("1/22/88", NY, "1988-01-22"), ("19/35/1990", NY, "INVALID"), ("1988.02.20", NY, "1988-02-20"), ("1988-01-28 02:52:02.519873", NY, "1988-01-28T07:52:02Z"),
    ("1988-02-08T07:10:24+02:00", NY, "1988-02-08T05:10:24Z"), ("1988/02/01 06:24:52 UTC-07:00", NY, "1988-02-01T13:24:52Z"), ("1992-08-20T25:35:00", NY, "INVALID"), ("1988-03-19 18:43 Pacific/Honolulu", NY, "1988-03-20T04:43:00Z"),
    ("19880131", NY, "1988-01-31"), ("19881301", NY, "INVALID"), ("20150704123001", HNL, "2015-07-04T22:30:01Z"), ("19880104T073038+0000", NY, "1988-01-04T07:30:38Z"), ("1000758259", NY, "2001-09-17T20:24:19Z"), ("1000344877495", NY, "2001-09-13T01:34:37Z"),
    ("594206627", NY, "1988-10-30T09:23:47Z"), ("568892022520", NY, "1988-01-11T09:33:42Z"), ("unknown", NY, "INVALID"), ("", NY, "INVALID"), (None, NY, None), ("x" * 50_000, NY, "INVALID"),
    ("1988-10-30T01:30:00", NY, "1988-10-30T05:30:00Z"), ("1989-04-02T02:03:00", NY, "1989-04-02T07:03:00Z"), ("1988-10-30T01:30:00", None, "INVALID"),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "id int, v string, tz string")
    got = {r.id: r.norm_text for r in ts.normalised(df, "v", "tz").collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]] == []


@pytest.mark.parametrize("value,want", [("Feb 1988", "1988-02"), ("JAN-88", "1988-01"), ("1988/2", "1988-02"), ("02/1988", "1988-02"), ("1-1988", "1988-01"), ("198803.0", "1988-03"), ("198813", "INVALID"), ("1997", "INVALID"), ("n/a", "INVALID"), ("20", "INVALID")])
def test_months(spark, value, want):
    df = spark.createDataFrame([(value, NY)], "v string, tz string")
    assert ts.normalised(df, "v", "tz", day_needed=False).first().norm_text == want
    assert ts.normalised(df, "v", "tz").first().norm_text == "INVALID"


def test_local_times_against_the_zone_database(spark):
    """Every zone by every name, years 1 to 9999, most of them 1900 to 2100; times near changes among them."""
    rnd = random.Random(3)
    zones = sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"})
    _, _, _, known = ts._database()
    changes = {name: [s for s, _, _ in spans[1:]] for name, spans in known}
    assert sorted(changes) == zones
    rows = []
    for i in range(len(zones) * 8):
        tz = zones[i % len(zones)]
        if i % 8 < 3 and changes[tz]:
            t = datetime(1970, 1, 1) + timedelta(seconds=rnd.choice(changes[tz]) + rnd.randint(-7200, 7200))
        else:
            y = rnd.randint(1900, 2100) if i % 8 < 7 else rnd.choice([1, 1500, 1850, 2400, 5000, 9998])
            t = datetime(y, 1, 1) + timedelta(seconds=rnd.randrange(365 * 86400))
        a = t.replace(tzinfo=ZoneInfo(tz), fold=0)  # of two hours the first; a skipped one with the offset before
        rows.append((i, t.isoformat()[:19], tz, a.astimezone(timezone.utc).isoformat()[:19] + "Z"))
    df = spark.createDataFrame(rows, "id int, v string, tz string, want string")
    wrong = ts.normalised(df, "v", "tz").filter("norm_text != want").select("v", "tz", "want", "norm_text", "time_status").collect()
    assert wrong == []


@pytest.mark.parametrize("value,tz,want,status", [("07/01/60 10:00", NY, "2060-07-01T14:00:00Z", "local"), ("07/01/1960 10:00", NY, "1960-07-01T14:00:00Z", "local"), ("07/01/2000 10:00", "UTC", "2000-07-01T10:00:00Z", "local"), ("07/01/2000 10:00", "US/Eastern", "2000-07-01T14:00:00Z", "local"), ("2000-01-01 10:00 Japan", NY, "2000-01-01T01:00:00Z", "local"), ("2000-01-01 10:00 Foo/Bar", NY, "INVALID", "invalid"), ("2000-01-01 10:00", "Foo/Bar", "INVALID", "unplaced")])
def test_zones_and_years_without_limits(spark, value, tz, want, status):
    r = ts.normalised(spark.createDataFrame([(value, tz)], "v string, tz string"), "v", "tz").first()
    assert (r.norm_text, r.time_status) == (want, status)


def test_day_of_a_moment_is_that_of_the_rows_zone(spark):
    rows = [("2000-01-01 23:00Z", "Asia/Tokyo", "2000-01-02"), ("2000-01-01 03:00Z", NY, "1999-12-31"), ("2300-07-01 03:30Z", NY, "2300-06-30"), ("2000-01-01 23:00Z", "Foo/Bar", "2000-01-01"), ("2000-01-01 23:00Z", None, "2000-01-01"), ("2000-01-01", NY, "2000-01-01")]
    got = ts.normalised(spark.createDataFrame(rows, "v string, tz string, want string"), "v", "tz").collect()
    assert [(str(r.local_day), r.v) for r in got if str(r.local_day) != r.want] == []


def test_documented_forms(spark):
    df = spark.createDataFrame([("04-JAN-88", "DD-MON-YY", True), ("31-FEB-88", "DD-MON-YY", False), ("4-JAN-88", "DD-MON-YY", False), ("04-jan-88", "DD-MON-YY", False), ("01/31/1999", "MM/DD/YYYY", True), ("13/31/1999", "MM/DD/YYYY", False), ("01/31/1999 ", "MM/DD/YYYY", False), ("199912", "yyyymm", True), ("199913", "yyyymm", False), (None, "yyyymm", False)], "v string, form string, want boolean")
    for form in ("DD-MON-YY", "MM/DD/YYYY", "yyyymm"):
        assert df.filter(F.col("form") == form).filter(ts.is_documented(F.col("v"), form) != F.col("want")).count() == 0


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "v string, tz string, year int, norm int")
    assert ts.normalised(df, "v", "tz").count() == 0
    both = spark.createDataFrame([("04-JAN-88", NY, 5)] * 2, "v string, tz string, year int")
    assert [(r.year, r.norm_text) for r in ts.normalised(both, "v", "tz").collect()] == [(5, "1988-01-04")] * 2


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "x")], "k int, at int, v string")
    assert {(r.k, r.v) for r in ts.latest(df, "k", "at", ["v"]).collect()} == {(1, "b"), (2, None)}
