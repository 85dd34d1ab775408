"""Lookups, overrides, allow-lists, first rows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, small, spread_lookup


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, otherwise: Column | None = None) -> DataFrame:
    """df with the table's value for its key, else otherwise. The table is made unique by key (smallest value); null keys find nothing."""
    t = small(table.groupBy(F.col(table_key).alias("_k")).agg(F.min(value).alias("_v")))
    v = F.col("_v") if otherwise is None else F.coalesce("_v", otherwise)
    return df.join(t, F.col(key) == F.col("_k"), "left").withColumn(out, v).drop("_k", "_v")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def override(df: DataFrame, keys: list[str], table: DataFrame, value: str, ordinal: str, old: str, unknown: str = "?") -> DataFrame:
    """df with old replaced by the table's last value for the keys; rows of the table that say unknown are skipped."""
    last = keep_first(table.filter((F.col(value) != unknown) & F.col(value).isNotNull()), keys, [F.desc(ordinal)]).select(*keys, F.col(value).alias("_new"))
    return df.join(small(last), keys, "left").withColumn(old, F.coalesce("_new", old)).drop("_new")


def allowed(df: DataFrame, key: str, allow: DataFrame) -> DataFrame:
    """Rows whose key is on the list."""
    return df.join(small(allow.select(key).distinct()), key, "left_semi")


def missing(df: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
    """Rows whose keys the other table lacks."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def duplicate_flag(df: DataFrame, col: str, out: str = "duplicated") -> DataFrame:
    """Whether another row has the same value; nulls are equal to each other. Counted by print and looked up, spread for a value that very many rows hold."""
    p = F.md5(F.coalesce(F.concat(F.lit("v"), F.col(col)), F.lit("n")))
    n = settled(df.groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_p", F.lit(True).alias(out)))
    return spread_lookup(df.withColumn("_p", p), n, "_p").withColumn(out, F.coalesce(out, F.lit(False))).drop("_p")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement, the same ones each time for a seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def patched(df: DataFrame, key: str, patches: DataFrame, col: str) -> DataFrame:
    """df with col replaced on the rows that patches (key, col) name."""
    p = small(patches.select(key, F.col(col).alias("_patch")))
    return df.join(p, key, "left").withColumn(col, F.coalesce("_patch", col)).drop("_patch")
