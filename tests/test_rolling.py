import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from monthloom.operators import rolling


def _brute(rows, periods):
    days = {}
    for e, d, v in rows:
        if e is not None and d is not None:
            days.setdefault(e, {}).setdefault(d, 0.0)
            days[e][d] += v or 0
    out = {}
    for e, m in days.items():
        d = min(m)
        while d <= max(m):
            out[e, d] = tuple(sum(m.get(d - dt.timedelta(i), 0) for i in range(p)) for p in periods)
            d += dt.timedelta(1)
    return out


def _rows(seed, n, span):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "c", None]), dt.date(1999, 12, 1) + dt.timedelta(r.randrange(span)) if r.random() > 0.05 else None, r.choice([None, 0, 1, 2, 5])) for _ in range(n)]


def test_against_brute_force(spark):
    rows = _rows(1, 400, 1500) + [("lone", dt.date(2001, 1, 1), 3)]
    df = spark.createDataFrame(rows, "e string, d date, v int")
    got = {(r.e, r.day): (r.v_total_7d, r.v_total_30d) for r in rolling.trailing_totals(df, "e", "d", ["v"]).collect()}
    assert got == _brute(rows, (7, 30))


def test_averages_and_rows(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 7), ("a", dt.date(2020, 1, 1), 7)], "e string, d date, v int")
    r = rolling.trailing_totals(df, "e", "d", ["v"]).first()
    assert (r.v_total_7d, r.v_avg_7d, r.rows_7d) == (14, 2, 2)


def test_empty(spark):
    assert rolling.trailing_totals(spark.createDataFrame([], "e string, d date, v int"), "e", "d", ["v"]).count() == 0


def test_long_periods(spark):
    rows = _rows(3, 60, 1200)
    df = spark.createDataFrame(rows, "e string, d date, v int")
    got = {(r.e, r.day): (r.v_total_3d, r.v_total_700d) for r in rolling.trailing_totals(df, "e", "d", ["v"], [3, 700]).collect()}
    assert got == _brute(rows, (3, 700))


def test_late_rows_change_stored_trees(spark, tmp_path):
    rows, late = _rows(2, 150, 900), [("a", dt.date(2000, 2, 2), 9), ("b", dt.date(2000, 3, 3), -1), ("new", dt.date(2003, 3, 3), 4)]
    one, two = (rolling.daily_sums(spark.createDataFrame(x, "e string, d date, v int"), "e", "d", ["v"]) for x in (rows, late))
    trees = rolling.StoredTrees(spark, str(tmp_path / "t"), ["v"], [7, 30]).build(one)
    before = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "t").glob("part=*")}
    old = spark.createDataFrame(trees.nodes().collect(), trees.nodes().schema)
    touched = trees.correct(two)
    after = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "t").glob("part=*")}
    assert {k for k in after if after[k] != before.get(k)} == {f"part={k}" for k in touched} and len(touched) <= 2 * 3
    changed = trees.nodes().alias("a").join(old.alias("b"), ["entity", "shard", "node"], "left").filter("b.m0 is null or a.m0 != b.m0").count()
    assert changed <= 3 * 2 * rolling.LEAVES.bit_length()
    got = {(r.entity, r.day): (r.v_total_7d, r.v_total_30d) for r in trees.totals().collect()}
    assert got == _brute(rows + late, (7, 30))


def test_rows_taken_back(spark, tmp_path):
    rows = [("a", dt.date(2000, 1, 1), 5, 1), ("a", dt.date(2000, 1, 5), 2, 1), ("a", dt.date(2000, 1, 9), 1, 1)]
    daily = lambda x: rolling.daily_sums(spark.createDataFrame(x, "e string, d date, v int, s int"), "e", "d", ["v"], F.col("s"))
    trees = rolling.StoredTrees(spark, str(tmp_path / "t"), ["v"], [7]).build(daily(rows))
    trees.correct(daily([("a", dt.date(2000, 1, 9), 1, -1), ("a", dt.date(2000, 1, 5), 2, -1), ("a", dt.date(2000, 1, 6), 3, 1)]))
    assert [(str(r.day), r.v_total_7d) for r in trees.totals().orderBy("day").collect()] == [(f"2000-01-0{i}", 5.0 if i < 6 else 8.0) for i in range(1, 7)]
    assert trees.correct(daily([])) == []


def test_tree_update_and_query():
    rnd = np.random.default_rng(1)
    leaves = rnd.integers(0, 9, (1, 3, 16)).astype(float)
    t = rolling.SegmentTrees(leaves.copy())
    t.update(1, 5, np.array([4.0]))
    leaves[0, 1, 5] += 4
    first, after = np.array([0, 3, 5, 7]), np.array([16, 4, 5, 12])
    want = np.stack([leaves[:, :, a:b].sum(2) for a, b in zip(first, after)], 2)
    assert (t.query(first, after) == want).all()
    assert t.node[0, 1, 1] == leaves[0, 1].sum()


def test_hot_entity_is_spread_over_shards(spark):
    df = spark.createDataFrame([("hot", dt.date(1990, 1, 1) + dt.timedelta(i), 1) for i in range(3000)], "e string, d date, v int")
    daily = rolling.daily_sums(df, "e", "d", ["v"])
    assert rolling._placed(daily, [7, 30]).groupBy("shard").count().agg(F.max("count")).first()[0] <= rolling.LEAVES
