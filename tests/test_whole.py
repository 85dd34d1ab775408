"""The whole wide report."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthloom.plans import panels, whole, wide
from monthloom.operators import embedding, panel

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_flagship_holds_all_text_columns(spark):
    df = entry.entry(spark)
    for f in ("narr", "syn", "call", "all", "nrsy"):
        for n in (1, 3, 6, 12):
            assert {f"{f}_{m}_{n}m" for m in ("wc", "wc_out", "wc_all", "abrvs", "nasa_out_avg", "lwc_time", "lwc_time_ff_all_pr")} | {f"trcn_{f}_{n}m", f"trcn_out_{f}_ff_{n}m", f"trcn_invall_{f}_{n}m"} <= set(df.columns)
    assert len(df.columns) == len(set(df.columns))


def _texts(spark, rows):
    return spark.createDataFrame([((e, f), m, f, t) for e, m, f, t in rows], "entity struct<entity: string, field: string>, month_idx int, field string, text string")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_word_facts_against_a_loop(spark):
    rows = [("x", 1, "syn", "captain apch sudden qqzz"), ("x", 1, "syn", "the captain"), ("x", 1, "narr", None), ("y", 2, "narr", "before rwy rwy")]
    got = {(r.entity.entity, r.entity.field): r.asDict() for r in whole.word_facts(spark, SF, _texts(spark, rows)).collect()}
    for key in {(e, f) for e, _, f, _ in rows}:
        words = Counter(w for e, _, f, t in rows if (e, f) == key for w in (t or "").split())
        assert got[key]["wc"] == words.total() and got[key]["n_reports"] == sum((e, f) == key for e, _, f, _ in rows)
        for g in whole.GROUPS:
            assert got[key][f"lwc_{g}"] == sum(words[w] for c, w in panels.CATEGORIES if c == g)
    assert got["x", "syn"]["nasa"] == 1 and got["x", "syn"]["abrvs"] >= 2  # apch; and qqzz, which no list knows
    assert (got["y", "narr"]["nasa"], got["y", "narr"]["faa"]) == (2, 2)


def test_totals_stay_within_their_group(spark):
    p = spark.createDataFrame([("a", 1, "s", 1), ("b", 1, "s", 2), ("a", 1, "t", 40)], "entity string, month_idx int, field string, v long")
    got = {(r.entity, r.field): (r.v_all, r.v_out) for r in panel.own_out_all(p, ["v"], ["field"]).collect()}
    assert got == {("a", "s"): (3, 2), ("b", "s"): (3, 1), ("a", "t"): (40, 0)}


def test_every_readable_date_counts(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("field_offices", [("O", "America/New_York")], "office_code string, tz_name string")
    put("airport_reference", [("AAA", "America/New_York")], "loc_id string, tz_name string")
    a = ["04-JAN-88", " 04-JAN-88 ", "1988-01-04", "1988-01-05T02:00:00Z", "568324800", "04-JAN-88 23:03", "31-FEB-88", None]  # the number is 1988-01-04 15:00 in New York
    put("faa_incidents", [(i, d, "AAA", None if i == 5 else "O", i) for i, d in enumerate(a)], "incident_id long, localeventdate string, tracon_code string, office_code string, received_ts long")
    put("ntsb_incidents", [(1, "01/04/1988", "KAAA", "Incident", "O", 1), (2, "4 January 1988", "AAA", "Accident", "O", 1)], "ntsb_id long, event_date string, airport_code string, investigation_type string, office_code string, received_ts long")
    r = ["198801", "JAN-88", "1988/1", "04-JAN-1988", "19880201T0200Z", "1988", None]  # the fifth is still January in New York
    put("asrs_reports", [(i, d, "AAA", "one two", None, None, None, 1) for i, d in enumerate(r)], "acn long, report_date string, facility_code string, narrative string, callback string, synopsis string, combined string, received_ts long")
    m = 1988 * 12 + 1
    for every, want, reports in ((False, (1, 1, 0, 1, 2, 1), 1), (True, (6, 1, 1, 2, 8, 6), 5)):
        base, top = wide.register_panel(spark, str(tmp_path), every)
        row = base.filter(f"month_idx = {m}").first()
        assert tuple(row)[2:] == want
        assert [(x.month_idx, x.n_reports, x.n_words) for x in wide.report_panel(spark, str(tmp_path), top, every).collect()] == [(m, reports, 2 * reports)]


def test_arrays_give_what_the_windows_do(spark):
    values = [[3, 0, 1, 7, 0, 0, 2, 5, 1, 0, 4, 9, 6, 1, 128], [1, 0, 3, 128, 0, 0, 64, 5, 1, 0, 4, 7, 6, 1, 3]]
    rows = [("a", m, *x) for m, x in enumerate(zip(*values))]
    for lag in (0, 1, 2):
        df = panel.ratios(panel.lagged(spark.createDataFrame(rows, "entity string, month_idx int, a long, b long"), ["a", "b"], [1, 3, 12], lag), {f"q{n}": (f"a_{n}m", f"b_{n}m") for n in (1, 3, 12)})
        want = [r.asDict() for r in df.orderBy("month_idx").collect()]
        for n, (sums, ok) in zip((1, 3, 12), panel.lagged_arrays(np.array(values), [1, 3, 12], lag)):
            q, there = panel.rounded_ratios(sums[0], sums[1])
            for i, r in enumerate(want):
                assert [r[f"a_{n}m"], r[f"b_{n}m"]] == ([*sums[:, i]] if ok[i] else [None, None])
                assert r[f"q{n}"] == (q[i] if ok[i] and there[i] else None)


def test_quotients_are_rounded_as_spark_does(spark):
    pairs = [(a, b) for b in (0, 1, 3, 7, 64, 128, 640, 1920, 3200000, 999983) for a in (0, 1, 3, 5, 77, 129, 1285, 20001, 123457)]
    df = panel.ratios(spark.createDataFrame(pairs, "a long, b long"), {"q": ("a", "b")})
    q, ok = panel.rounded_ratios(*np.array(pairs).T)
    assert [r.q for r in df.collect()] == [x if t else None for x, t in zip(q.tolist(), ok)]


def test_repeated_texts_are_named_once(spark):
    rows = [(1, "x y", "a"), (2, "x y", None), (3, "z", "a"), (4, " \t", "b"), (5, None, "a"), (6, "x y", "c")]
    again, different = embedding.repeats(spark.createDataFrame(rows, "k long, s string, t string"), "k", {"s": F.col("s"), "t": F.col("t")})
    assert sorted(map(tuple, again.collect())) == [("s", 2), ("s", 6), ("t", 3), ("t", 5)] and different == {"s": 2, "t": 3}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_no_plan_joins_the_wide_columns(spark):
    plan = entry.entry(spark)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    left = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "..")
    assert not [f for d, _, fs in os.walk(left) for f in fs if f.endswith(".zstd.parquet")]  # stored texts are removed
