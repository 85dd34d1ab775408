"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import panels, problems, sourced, whole, wide


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return panels.QUERIES | wide.QUERIES | whole.QUERIES | sourced.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return panels.ORACLE | wide.ORACLE | sourced.ORACLE | problems.ORACLE


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return whole.final_wide_whole(spark, sf)
