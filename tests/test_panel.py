import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from monthloom.operators import panel, registers


def _dense(spark, rows, first, last):
    facts = spark.createDataFrame(rows, "entity string, month_idx int, v long")
    return panel.dense(facts, facts.select("entity"), first, last, ["v"])


def test_gap_makes_the_window_null(spark):
    p = _dense(spark, [("a", 1, 1), ("a", 2, None), ("a", 3, 3), ("a", 5, 5), ("a", 6, 6), ("a", 7, 7)], 1, 9)
    got = {r.month_idx: r.v_3m for r in panel.lagged(p, ["v"], [3]).collect()}
    assert got == {m: None for m in range(1, 10)} | {8: 18}


@pytest.mark.parametrize("lag", [1, 2])
def test_frames(spark, lag):
    p = _dense(spark, [("a", m, 10**m) for m in range(1, 15)], 1, 14)
    for r in panel.lagged(p, ["v"], [1, 3, 6, 12], lag).collect():
        for n in (1, 3, 6, 12):
            want = [m for m in range(r.month_idx - (n + lag - 1), r.month_idx - lag + 1)]
            assert r[f"v_{n}m"] == (sum(10**m for m in want) if min(want) >= 1 else None)


def test_rows_of_other_entities_stay_out(spark):
    p = _dense(spark, [(e, m, k) for m in range(1, 4) for e, k in (("a", 1), ("b", 100))], 1, 4)
    got = {(r.entity, r.month_idx): r.v_3m for r in panel.lagged(p, ["v"], [3]).collect()}
    assert (got["a", 4], got["b", 4]) == (3, 300)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 20), st.one_of(st.none(), st.integers(0, 9))), max_size=40, unique_by=lambda t: t[:2]), st.sampled_from([1, 3, 6]), st.sampled_from([1, 2]))
def test_windows_against_a_band_join(spark, rows, n, lag):
    p = _dense(spark, rows, 1, 22)
    got = {(r.entity, r.month_idx): r[f"v_{n}m"] for r in panel.lagged(p, ["v"], [n], lag).collect()}
    facts = {(e, m): v for e, m, v in rows}
    for e in {e for e, _, _ in rows}:
        for m in range(1, 23):
            vs = [facts.get((e, x)) for x in range(m - n - lag + 1, m - lag + 1)]
            assert got[e, m] == (None if None in vs else sum(vs))


def test_own_out_all(spark):
    p = _dense(spark, [("a", 1, 1), ("b", 1, 5), ("a", 2, None), ("b", 2, 4)], 1, 3)
    got = {(r.entity, r.month_idx): (r.v_all, r.v_out) for r in panel.own_out_all(p, ["v"]).collect()}
    assert got == {("a", 1): (6, 5), ("b", 1): (6, 1), ("a", 2): (4, 4), ("b", 2): (4, 0), ("a", 3): (None, None), ("b", 3): (None, None)}


def test_ratios_and_coverage(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 1)], "a int, b int")
    r = panel.ratios(df, {"q": ("a", "b")})
    assert [x.q for x in r.collect()] == [0.5, None, None]
    assert {x.column_name: (x.n_null, x.n_rows) for x in panel.coverage(r).collect()} == {"a": (1, 3), "b": (0, 3), "q": (2, 3)}
    assert {x.n_null for x in panel.coverage(df.limit(0)).collect()} == {0}


def test_overlap(spark):
    a = spark.createDataFrame([("x", 1, 5)] * 2 + [("x", 1, 6), (None, 1, 5)], "entity string, month_idx int, day int")
    b = spark.createDataFrame([("x", 1, 5)] * 3 + [("x", 1, 7), (None, 1, 5)], "entity string, month_idx int, day int")
    o = registers.overlap(a, b, ["entity", "month_idx", "day"], ["entity", "month_idx"])
    assert [tuple(r) for r in o.collect()] == [("x", 1, 2)]
    u = registers.with_overlap(spark.createDataFrame([("x", 1), ("y", 1)], "entity string, month_idx int"), o, ["entity", "month_idx"])
    assert {r.entity: r.n_overlap for r in u.collect()} == {"x": 2, "y": 0}


def test_union_and_classes(spark):
    e = spark.createDataFrame([("x", "Incident"), ("x", None), (None, "Accident")], "entity string, kind string")
    c = registers.class_counts(e, ["entity"], "kind", {"i": "Incident", "a": "Accident"})
    u = registers.union_totals([c, registers.counts(e, ["entity"], "n", "kind")], ["entity"], ["i", "a", "n"])
    assert {r.entity: (r.i, r.a, r.n) for r in u.collect()} == {"x": (1, 0, 1), None: (0, 1, 1)}


def test_lagged_distinct(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(1, 9), r.choice("uvwxyz")) for _ in range(60)]
    got = {(x.entity, x.month_idx): x.n_words for x in panel.lagged_distinct(spark.createDataFrame(rows, "entity string, month_idx int, word string"), 3, 1, 12).collect()}
    want = {(e, m): len({w for a, k, w in rows if a == e and m - 3 <= k <= m - 1}) for e in "ab" for m in range(1, 13)}
    assert got == {k: v for k, v in want.items() if v}


def test_infinite_window(spark):
    p = _dense(spark, [("a", 1, 1), ("a", 2, 2), ("a", 4, 4)], 1, 5)
    assert {r.month_idx: r.v_atime for r in panel.lagged(p, ["v"], [None]).collect()} == {1: None, 2: 1, 3: 3, 4: None, 5: None}


def test_empty(spark):
    p = _dense(spark, [], 1, 3)
    assert p.count() == panel.own_out_all(p, ["v"]).count() == panel.lagged(p, ["v"], [1]).count() == 0
    assert panel.label(3) == "3m" and panel.label(None) == "atime"
