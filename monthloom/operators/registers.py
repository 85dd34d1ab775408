"""Counts of event registers, their union, and events that two of them share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, keys: list[str], name: str, value: str | None = None) -> DataFrame:
    """Rows per key, or rows whose value isn't null. Null keys are a group of their own."""
    return events.groupBy(*keys).agg(F.count(F.lit(1) if value is None else F.col(value)).alias(name))


def class_counts(events: DataFrame, keys: list[str], kind: str, classes: dict[str, str]) -> DataFrame:
    """One column per class, name -> value of kind; classes that don't occur count 0."""
    return events.groupBy(*keys).agg(*[F.count_if(F.col(kind) == v).alias(k) for k, v in classes.items()])


def union_totals(parts: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of the measures over registers that have some of them each; what a register lacks counts 0."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in measures])


def overlap(a: DataFrame, b: DataFrame, keys: list[str], month_keys: list[str]) -> DataFrame:
    """(month_keys, n_overlap): per key (entity and day) the smaller of both registers' counts, summed by month. Null keys match nothing."""
    both = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b")), keys)
    return both.groupBy(*month_keys).agg(F.sum(F.least("_a", "_b")).alias("n_overlap"))


def with_overlap(df: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """df with n_overlap, 0 where nothing is shared."""
    return df.join(shared, keys, "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))


def statistics(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition, and all rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in flags.items()])
