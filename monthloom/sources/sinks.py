"""Sinks: parquet and delimited files, one file set per value, rows set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Writes df; by: one folder per value of these columns, each written by few tasks."""
    if by:
        df = df.repartition(*by)
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def quarantine(df: DataFrame, bad: Column, path: str) -> DataFrame:
    """Writes the rows for which bad holds to path and returns the rest. A null condition counts as not bad."""
    flag = F.coalesce(bad, F.lit(False))
    df.filter(flag).write.mode("overwrite").parquet(path)
    return df.filter(~flag)
