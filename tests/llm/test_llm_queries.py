"""Queries of this subpackage against their SQL over the smallest tables."""

import pytest

from monthloom.llm import queries
from tests.test_queries import SF, pytestmark, same_rows, sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, sql, name):  # noqa: F811
    same_rows(queries.QUERIES[name](spark, SF), sql, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
