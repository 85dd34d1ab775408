"""Totals over trailing periods from segment trees per entity and time shard.

Trees are built for one run (trailing_totals) or kept in a table (StoredTrees), where late rows change only the ancestors of their days, and only the files that hold them. A shard of an entity's days is the leaves of a complete binary tree, whose nodes store sums and counts. The leaves hold the shard's
own days and, before them, as many of the days before as the longest period reaches back, so that each shard answers for itself and one
hot entity is spread over its shards. Trees of many shards are built and queried together as the rows of one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Leaves of a tree at least.
LEAVES = 512


def leaves_for(periods: list[int]) -> int:
    """The leaves of a tree: a power of two of at least twice the longest period."""
    if not periods or min(periods) < 1:
        raise ValueError("a period has at least one day")
    return max(LEAVES, 1 << (2 * max(periods) - 1).bit_length())


class SegmentTrees:
    """Trees over a batch of shards: an array (measures, shards, 2 * leaves); node i has the children 2i and 2i + 1, leaf p is node leaves + p."""

    def __init__(self, leaves: np.ndarray) -> None:
        m, n, self.leaves = leaves.shape
        self.node = np.zeros((m, n, 2 * self.leaves), dtype=leaves.dtype)
        self.node[:, :, self.leaves :] = leaves
        size = self.leaves
        while size > 1:
            level = self.node[:, :, size : 2 * size]
            self.node[:, :, size // 2 : size] = level[:, :, 0::2] + level[:, :, 1::2]
            size //= 2

    @classmethod
    def of_nodes(cls, node: np.ndarray) -> "SegmentTrees":
        """From stored nodes, without building."""
        out = cls.__new__(cls)
        out.node, out.leaves = node, node.shape[2] // 2
        return out

    def update(self, shard: int, leaf: int, delta: np.ndarray) -> None:
        """Adds delta to a leaf and its ancestors only."""
        i = self.leaves + leaf
        while i:
            self.node[:, shard, i] += delta
            i //= 2

    def query(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The sums of leaves first[j] up to but without after[j], for all shards: (measures, shards, j)."""
        lo, hi = first + self.leaves, after + self.leaves
        out = np.zeros((*self.node.shape[:2], len(lo)), dtype=self.node.dtype)
        while (lo < hi).any():
            k = np.flatnonzero((lo < hi) & (lo & 1 == 1))
            out[:, :, k] += self.node[:, :, lo[k]]
            lo = np.where((lo < hi) & (lo & 1 == 1), lo + 1, lo)
            k = np.flatnonzero((lo < hi) & (hi & 1 == 1))
            out[:, :, k] += self.node[:, :, hi[k] - 1]
            hi = np.where((lo < hi) & (hi & 1 == 1), hi - 1, hi)
            lo, hi = np.where(lo < hi, lo // 2, lo), np.where(lo < hi, hi // 2, hi)
        return out


def _placed(daily: DataFrame, periods: list[int]) -> DataFrame:
    """daily (entity, day_no, ...) with (shard, leaf); a day near a shard's end stands in the next one too."""
    halo = max(periods) - 1
    own = leaves_for(periods) - halo
    k, p = F.floor(F.col("day_no") / own), F.pmod("day_no", F.lit(own))
    here = F.struct(k.alias("shard"), (p + halo).cast("int").alias("leaf"))
    nxt = F.struct((k + 1).alias("shard"), (p + halo - own).cast("int").alias("leaf"))
    at = F.when(p >= own - halo, F.array(here, nxt)).otherwise(F.array(here)) if halo else F.array(here)
    return daily.withColumn("_at", F.explode(at)).select("*", "_at.shard", "_at.leaf").drop("_at")


def daily_sums(rows: DataFrame, entity: str, day: str, measures: list[str], sign: Column | None = None) -> DataFrame:
    """(entity, day_no, measures, n): rows summed by entity and day; null measures are 0, rows without entity or day are left out. sign: 1 for rows that come, -1 for rows that go."""
    by = F.lit(1.0) if sign is None else sign.cast("double")
    rows = rows.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).withColumn("_by", by)
    return rows.groupBy(F.col(entity).alias("entity"), F.unix_date(day).alias("day_no")).agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("_by")).alias(f"m{i}") for i, c in enumerate(measures)], F.sum("_by").alias("n"))


def tree_nodes(daily: DataFrame, periods: list[int], n_measures: int) -> DataFrame:
    """The stored form of the trees: (entity, shard, node, m0.., n), without nodes that cover no row."""
    leaves = leaves_for(periods)
    up = F.transform(F.sequence(F.lit(0), F.lit(leaves.bit_length() - 1)), lambda j: F.floor((F.lit(leaves) + F.col("leaf")) / F.pow(F.lit(2), j)).cast("int"))
    return _summed(_placed(daily, periods).withColumn("node", F.explode(up)), n_measures)


def _summed(nodes: DataFrame, n_measures: int) -> DataFrame:
    return nodes.groupBy("entity", "shard", "node").agg(*[F.sum(c).alias(c) for c in (*[f"m{i}" for i in range(n_measures)], "n")])


class StoredTrees:
    """Segment trees in a table of files, cut into parts by entity and shard.

    Late rows touch the parts that hold their shards: those are read, the ancestors of the late days are added to, and those parts alone are written again. Everything else stays as it is.
    Only the numbers of the touched parts, at most parts of them, come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, measures: list[str], periods: list[int], parts: int = 64) -> None:
        self.spark, self.path, self.measures, self.periods, self.parts = spark, path, measures, periods, parts

    def _write(self, nodes: DataFrame, mode: str) -> None:
        part = F.pmod(F.xxhash64("entity", "shard"), F.lit(self.parts)).cast("int")
        out = nodes.withColumn("part", part).repartition("part").write.partitionBy("part").mode(mode)
        out.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def build(self, daily: DataFrame) -> "StoredTrees":
        """Stores the trees of daily sums."""
        self._write(tree_nodes(daily, self.periods, len(self.measures)), "errorifexists")
        return self

    def nodes(self, touched: list[int] | None = None) -> DataFrame:
        """The stored nodes, of the touched parts only if they are given."""
        stored = self.spark.read.parquet(self.path)
        return stored if touched is None else stored.filter(F.col("part").isin(touched))

    def correct(self, late: DataFrame) -> list[int]:
        """Takes in late daily sums, which may hold negative amounts; gives the parts that were written again."""
        delta = settled(tree_nodes(late, self.periods, len(self.measures)).withColumn("part", F.pmod(F.xxhash64("entity", "shard"), F.lit(self.parts)).cast("int")))
        touched = sorted(r["part"] for r in delta.select("part").distinct().collect())
        if touched:
            both = self.nodes(touched).drop("part").unionByName(delta.drop("part"))
            self._write(settled(_summed(both, len(self.measures))), "overwrite")  # settled, as it reads what it replaces
        return touched

    def totals(self, entity: str = "entity") -> DataFrame:
        """As trailing_totals, without building a tree; an entity's days go from its first to its last with a row."""
        nodes, leaves, halo = self.nodes().drop("part"), leaves_for(self.periods), max(self.periods) - 1
        own = nodes.filter((F.col("node") >= leaves + halo) & (F.col("n") > 0))
        day = F.col("shard") * (leaves - halo) + F.col("node") - leaves - halo
        bounds = own.groupBy("entity").agg(F.min(day).cast("int").alias("lo"), F.max(day).cast("int").alias("hi"))
        return _result(_shards(nodes, bounds, self.periods, len(self.measures), "node"), self.periods, self.measures, entity, True)


def _answers(periods: list[int], n_measures: int, names: list[str], stored: bool):
    halo, leaves = max(periods) - 1, leaves_for(periods)
    own = leaves - halo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                n = b.num_rows
                shard = b.column("shard").to_numpy(zero_copy_only=False).astype(np.int64)
                lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
                lists = b.column("cells")
                size = np.diff(lists.offsets.to_numpy())
                size = np.where(np.asarray(lists.is_valid()), size, 0)
                cells = lists.flatten()
                at = np.repeat(np.arange(n), size)
                pos = cells.field("pos").to_numpy(zero_copy_only=False).astype(np.int64) if len(cells) else np.zeros(0, np.int64)
                room = np.zeros((n_measures + 1, n, 2 * leaves if stored else leaves))
                for i, c in enumerate([*[f"m{j}" for j in range(n_measures)], "n"]):
                    if len(cells):
                        np.add.at(room[i], (at, pos), cells.field(c).to_numpy(zero_copy_only=False))
                trees = SegmentTrees.of_nodes(room) if stored else SegmentTrees(room)
                leaf = np.arange(halo, leaves)
                day = shard[:, None] * own + (leaf - halo)[None, :]
                keep = (day >= lo[:, None]) & (day <= hi[:, None])
                out = [b.column("entity").take(pa.array(np.repeat(np.arange(n), keep.sum(1)))), pa.array(day[keep].astype(np.int32))]
                for w in periods:
                    got = trees.query(leaf - w + 1, leaf + 1)
                    for i in range(n_measures):
                        out += [pa.array(got[i][keep]), pa.array(got[i][keep] / w)]
                    out.append(pa.array(got[n_measures][keep].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _shards(found: DataFrame, bounds: DataFrame, periods: list[int], n_measures: int, key: str) -> DataFrame:
    own = leaves_for(periods) - (max(periods) - 1)
    cells = found.groupBy("entity", "shard").agg(F.collect_list(F.struct(F.col(key).alias("pos"), *[f"m{i}" for i in range(n_measures)], "n")).alias("cells"))
    spans = bounds.select("entity", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / own), F.floor(F.col("hi") / own))).alias("shard"))
    return spans.join(cells, ["entity", "shard"], "left")


def _result(shards: DataFrame, periods: list[int], measures: list[str], entity: str, stored: bool) -> DataFrame:
    fields = [T.StructField("entity", shards.schema["entity"].dataType), T.StructField("day_no", T.IntegerType())]
    for w in periods:
        for c in measures:
            fields += [T.StructField(f"{c}_total_{w}d", T.DoubleType()), T.StructField(f"{c}_avg_{w}d", T.DoubleType())]
        fields.append(T.StructField(f"rows_{w}d", T.LongType()))
    schema = T.StructType(fields)
    out = shards.select("entity", "shard", "lo", "hi", "cells").mapInArrow(_answers(periods, len(measures), [f.name for f in fields], stored), schema)
    return out.select(F.col("entity").alias(entity), F.date_from_unix_date("day_no").alias("day"), *[f.name for f in fields[2:]])


def _bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("entity").agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))


def trailing_totals(rows: DataFrame, entity: str, day: str, measures: list[str], periods: list[int] = [7, 30]) -> DataFrame:
    """One row per entity and calendar day from its first to its last day with a row: totals, daily averages and numbers of rows over each trailing period.

    rows: any number of rows per entity and day, which add up. Null measures are 0; rows without entity or day are left out; days before
    an entity's first day count as 0; the average divides by the period's length. Extra columns are ignored; an empty table gives an empty table.
    A period may have any number of days from 1; longer ones make larger trees.
    """
    leaves_for(periods)
    daily = daily_sums(rows, entity, day, measures)
    shards = _shards(_placed(daily, periods), _bounds(daily), periods, len(measures), "leaf")
    return _result(shards, periods, measures, entity, False)
