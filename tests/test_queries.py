"""Queries against their SQL over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from monthloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def _plain(x):
    return None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sql, name):
    same_rows(catalog.queries()[name](spark, SF), sql, catalog.oracle_sql()[name])


def same_rows(df, sql, text):
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = sql.execute(text)
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    want = sorted((tuple(_plain(r[have.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
