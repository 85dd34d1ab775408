"""Containers of fixed capacity filled with items of varying length: minimum bin slack on the histogram of lengths.

Only how many items have each length matters for the packing, and that is bounded by the capacity, whatever the number of items. Per container the largest item
left is fixed and a subset-sum over the lengths left, kept as bits of one integer, finds the fullest feasible completion; the pattern found is taken as
often as its lengths last. Items are then dealt to the places of their length by their rank, which is computed in salted groups.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, small

CAPACITY = 2048
#: Items of one length that are ranked in one group.
GROUP = 500_000


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file of the tokenizer: the path given, or the public 50k byte-level one."""
    return path or os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


#: How a text is cut before byte pairs are merged: the public pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    """Counts tokens of texts; remembers the counts of pieces."""

    def __init__(self, path: str) -> None:
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens); null texts are left out, empty ones have none."""
    where = vocabulary_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _COUNTERS.get(where) or _COUNTERS.setdefault(where, TokenCounter(where))
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int32())], names=[key, "n_tokens"])

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.IntegerType())])
    return df.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """Lengths, each at most as often as it is there, whose sum comes closest to room without passing it."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return out


def packed(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths) of the containers, in order; lengths from 1 to capacity."""
    left = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        use = fullest(rest, capacity - top)
        use[top] += 1
        times = min(left[k] // n for k, n in use.items())
        out.append((times, dict(use)))
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, number per container, first container), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for times, use in plan:
        for length, n in use.items():
            out.setdefault(length, []).append((used[length], n, first))
            used[length] += n * times
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def fill(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first, size, container_id): every item in a container of the capacity.

    An item larger than the capacity is divided into pieces of the capacity and one rest; others stay whole. Items of size 0 go to container 0 and take no room; null sizes are left out;
    repeated keys are items of their own; an empty table gives no rows. Containers are numbered from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.col(size)
    pieces = items.filter(n.isNotNull()).select(key, n.cast("long").alias("_n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1))))
    pieces = settled(pieces.select(key, "piece", (F.col("piece").cast("long") * capacity).alias("first"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias(size)))
    hist = {r[0]: r[1] for r in pieces.groupBy(size).count().collect()}  # at most capacity + 1 rows
    at = places(packed(hist, capacity))
    salts = max(1, -(-max(hist.values(), default=0) // GROUP))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    sizes = salted.groupBy(size, "_salt").count()
    before = sizes.select(size, "_salt", (F.sum("count").over(Window.partitionBy(size).orderBy("_salt")) - F.col("count")).alias("_before"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(size, "_salt").orderBy(key, "piece"))).join(small(before), [size, "_salt"])
    sent = items.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            lengths, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                if length > 0:
                    rows, k = table[int(length)], np.flatnonzero(lengths == length)
                    p = rows[np.searchsorted(rows[:, 0], rank[k], side="right") - 1]
                    out[k] = p[:, 2] + (rank[k] - p[:, 0]) // p[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=[key, "piece", "first", size, "container_id"])

    dealt = ranked.select(key, "piece", "first", size, (F.col("_before") + F.col("_r") - 1).alias("_rank"))
    schema = T.StructType([*[dealt.schema[c] for c in (key, "piece", "first", size)], T.StructField("container_id", T.LongType())])
    return dealt.mapInArrow(run, schema)
