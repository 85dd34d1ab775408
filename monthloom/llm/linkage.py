"""Records of two tables matched without a common key: blocking in several passes, agreement levels, probabilities by expectation-maximisation.

Candidate pairs come from an equi-join on the prints of several attributes each, pass by pass. Their attributes are compared to levels, and equal
level patterns are counted; their number is bounded by the levels. Expectation-maximisation estimates how often matches and non-matches show each level, and the share of
matches among all pairs of the two tables. All pairs are the candidates, every one of them, and the others, which count as non-matches; random pairs, a few for every record, stand for them. The
posterior of a pair's pattern is its confidence. Each record keeps at most one partner.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, spread_lookup

#: Highest level of each comparison; level 0 is disagreement, -1 means that a side says nothing.
LEVELS = {"day": 2, "loc": 2, "tail": 3, "model": 2, "phase": 1, "persons": 1, "office": 2}
#: Least confidence of a link.
LEAST = 0.75
ROUNDS = 200
#: Random pairs for each record of the smaller table.
DRAWS = 2
#: So few pairs are settled on the driver.
FINISH = 20_000
#: Records of one table with the same key that one task of the candidates' join takes.
HOT = 2_000
#: Buckets by which hot keys are looked for.
BUCKETS = 1 << 16


def _compared(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The level of each comparison of a joined pair. What another attribute implies says nothing: the model of the same aircraft, the office of the same place."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    unsaid = lambda c: x(c).isNull() | y(c).isNull()
    tx, ty = F.regexp_replace(x("tail"), r"\*+$", ""), F.regexp_replace(y("tail"), r"\*+$", "")
    n = F.least(F.length(tx), F.length(ty))
    cut = (x("tail").endswith("*") | y("tail").endswith("*")) & (n >= 4)
    same_letters = F.sort_array(F.split(tx, "")) == F.sort_array(F.split(ty, ""))
    gap = F.levenshtein(tx, ty)
    same_tail = ~unsaid("tail") & (tx == ty)
    near = (F.abs(x("lat") - y("lat")) < 0.35) & (F.abs(x("lon") - y("lon")) < 0.35)
    return {
        "day": F.when(unsaid("day"), -1).when(x("day") == y("day"), 2).when(F.abs(x("day") - y("day")) == 1, 1).otherwise(0),
        "loc": F.when(x("loc") == y("loc"), 2).when(near, 1).when(unsaid("loc") & unsaid("lat"), -1).otherwise(0),
        "tail": F.when(unsaid("tail"), -1).when(tx == ty, 3).when(cut & (F.substring(tx, F.lit(1), n) == F.substring(ty, F.lit(1), n)), 2).when((gap <= 1) | (same_letters & (gap <= 2)), 2).when(gap <= 3, 1).otherwise(0),
        "model": F.when(unsaid("make") | same_tail, -1).when(x("make") != y("make"), 0).when(unsaid("model"), 1).when(x("model") == y("model"), 2).otherwise(0),
        "phase": F.when(unsaid("phase"), -1).when(x("phase") == y("phase"), 1).otherwise(0),
        "persons": F.when(unsaid("persons"), -1).when(x("persons") == y("persons"), 1).otherwise(0),
        "office": F.when(unsaid("office") | (x("loc") == y("loc")), -1).when(x("office") == y("office"), 2).when(F.substring(x("office"), 1, 3) == F.substring(y("office"), 1, 3), 1).otherwise(0),
    }


#: The passes: key columns of each; day is matched with its neighbours. Columns are those of _keys.
#: Without a tail at least four attributes must agree, so that the blocks of one hot place and day stay small.
PASSES = [("day", "tail"), ("tail", "loc"), ("day", "loc", "make", "phase"), ("day", "tail_head"), ("day", "loc", "make", "persons"), ("day", "loc", "phase", "persons"), ("day", "make", "phase", "persons"), ("tail", "make", "model", "persons")]


def _keys(df: DataFrame) -> DataFrame:
    """Tails cut off count as their beginning."""
    whole = F.when(F.col("tail").endswith("*"), None).otherwise(F.col("tail"))
    return df.withColumn("tail_head", F.when(F.length("tail") >= 4, F.substring("tail", 1, 3))).withColumn("tail", F.col("tail")).withColumn("tail_key", whole)


def _block_keys(df: DataFrame, out: str, shifts: tuple[int, ...]) -> DataFrame:
    """(key, out): a 64-bit print of every pass's key values of a record, on the day shifted by each of shifts; passes with a null among their columns give none."""
    df = _keys(df)
    prints = []
    for i, keys in enumerate(PASSES):
        cols = ["tail_key" if k == "tail" else k for k in keys]
        there = F.col(cols[0]).isNotNull()
        for c in cols[1:]:
            there = there & F.col(c).isNotNull()
        for shift in shifts if "day" in keys else (0,):
            prints.append(F.when(there, F.xxhash64(F.lit(i), *[F.col(c) + shift if c == "day" else F.col(c) for c in cols])))
    return df.select(F.explode(F.array_compact(F.array(*prints))).alias("key"), F.col("id").alias(out))


def _split(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """a and b (key, id each) with what they are to be joined by: keys that more than HOT records of a table share are cut into parts on that side, and the other side's records go to each part."""
    def counts(df: DataFrame, n: str) -> DataFrame:
        # a key of more than HOT records lies in a bucket of more, so only the keys of such buckets are counted each
        bucket = F.pmod("key", F.lit(BUCKETS)).alias("bucket")
        full = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("bucket")
        some = df.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")  # at most BUCKETS rows
        return some.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias(n)).filter(F.col(n) > 1)

    hot = settled(counts(a, "pa").join(counts(b, "pb"), "key", "full").select("key", F.coalesce("pa", F.lit(1)).alias("pa"), F.coalesce("pb", F.lit(1)).alias("pb")))
    if hot.limit(1).count() == 0:
        return a, b, ["key"]

    def parted(df: DataFrame, key: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        d = spread_lookup(df, hot, "key")
        d = d.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1))).drop("pa", "pb")

    return parted(a, "a_id", "pa", "at_a", "at_b", "pb"), parted(b, "b_id", "pb", "at_b", "at_a", "pa"), ["key", "at_a", "at_b"]


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, levels): each candidate pair once. Only prints and ids are shuffled to find the pairs; two prints that meet by chance add a candidate and lose none. A block of one key is split
    over tasks; its pairs are all compared, since the records of a block differ in what isn't in its key."""
    left, right, on = _split(_block_keys(a, "a_id", (0,)), _block_keys(b, "b_id", (-1, 0, 1)))
    pairs = left.join(right, on).select("a_id", "b_id").distinct()
    both = pairs.join(a.alias("a"), F.col("a_id") == F.col("a.id")).join(b.alias("b"), F.col("b_id") == F.col("b.id"))
    return both.select("a_id", "b_id", *[c.cast("int").alias(k) for k, c in _compared().items()])


def random_levels(a: DataFrame, b: DataFrame, pairs: DataFrame, places: int) -> DataFrame:
    """Level patterns of random pairs that are no candidates, about DRAWS for each record of the smaller table: records meet where their hashes fall into the same of places, the number of records of the larger."""
    draw = lambda df: df.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("_place", F.pmod(F.xxhash64("id", F.col("_draw") + (F.lit(0) if df is a else F.lit(1000))), F.lit(places)))
    left, right = draw(a).alias("a"), draw(b).alias("b")
    met = left.join(right, (F.col("a._draw") == F.col("b._draw")) & (F.col("a._place") == F.col("b._place"))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *[c.cast("int").alias(k) for k, c in _compared().items()])
    return met.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")


def _patterns(levels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how many pairs show each)."""
    rows = levels.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).collect()  # at most the product of the numbers of levels
    return np.array([[r[c] for c in LEVELS] for r in rows], dtype=int).reshape(-1, len(LEVELS)), np.array([r["n"] for r in rows], float)


def shares(patterns: np.ndarray, counts: np.ndarray, tops: list[int], prior: float = 0.5) -> list[np.ndarray]:
    """The share of each level of each comparison among the pairs in which both sides say something."""
    out = []
    for j, top in enumerate(tops):
        said = patterns[:, j] >= 0
        seen = np.bincount(patterns[said, j], weights=counts[said], minlength=top + 1) + prior
        out.append(seen / seen.sum())
    return out


def estimated(patterns: np.ndarray, counts: np.ndarray, tops: list[int], other: tuple[np.ndarray, np.ndarray], all_pairs: float) -> tuple[np.ndarray, float, list[np.ndarray], list[np.ndarray]]:
    """(posterior of each pattern, share of matches among all pairs, levels of matches, levels of non-matches) by expectation-maximisation; -1 levels say nothing.

    patterns and counts are those of the candidates, other those of random pairs, which stand for all pairs that are no candidates. Levels that random pairs hardly ever show, as the same tail, are
    so learnt from the candidates that are no matches, which hold nearly all such pairs, and not from the number of draws.
    """
    m = [np.concatenate([[0.05], 0.95 * np.arange(1, t + 1) / (t * (t + 1) / 2)]) for t in tops]
    weight = max(all_pairs - counts.sum(), 1.0) / max(other[1].sum(), 1.0)
    every = np.concatenate([patterns, other[0]])
    u = shares(*other, tops)
    share = min(0.5, 0.5 * counts.sum() / all_pairs)
    post = np.zeros(len(counts))
    for _ in range(ROUNDS):
        gap = np.full(len(counts), math.log(1 - share) - math.log(share))
        for j in range(len(tops)):
            said = patterns[:, j] >= 0
            gap[said] += np.log(u[j][patterns[said, j]]) - np.log(m[j][patterns[said, j]])
        new = 1 / (1 + np.exp(np.clip(gap, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        share = float(np.clip((post * counts).sum() / all_pairs, 1e-15, 0.5))
        m = shares(patterns, post * counts, tops, 0.05)
        u = shares(every, np.concatenate([(1 - post) * counts, weight * other[1]]), tops)
    return post, share, m, u


def scored(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs with the confidence of their pattern."""
    pat, counts = _patterns(pairs)
    if not len(pat):
        return pairs.withColumn("confidence", F.lit(0.0))
    n_a, n_b = max(a.count(), 1), max(b.count(), 1)
    post, *_ = estimated(pat, counts, list(LEVELS.values()), _patterns(random_levels(a, b, pairs, max(n_a, n_b))), float(n_a) * n_b)
    known = pairs.sparkSession.createDataFrame([(*map(int, p), float(c)) for p, c in zip(pat, post)], ", ".join(f"{c} int" for c in LEVELS) + ", confidence double")
    return pairs.join(F.broadcast(known), list(LEVELS))  # one row a pattern


def one_to_one(pairs: DataFrame, finish: int = FINISH) -> DataFrame:
    """Of scored pairs those that are the best for both their records; then the same among what is left, until nothing is.

    Ties go by a print of the pair, so that a round settles many pairs of a block of equals. Once no more than finish pairs are left, the driver takes them in the same order, which gives the same links.
    """
    order = [F.desc("confidence"), "gap", "_tie"]
    rest, out = settled(pairs.withColumn("_tie", F.xxhash64("a_id", "b_id"))), None
    while rest.count() > finish:
        wa = Window.partitionBy("a_id").orderBy(*order, "b_id")
        wb = Window.partitionBy("b_id").orderBy(*order, "a_id")
        best = rest.withColumn("ra", F.row_number().over(wa)).withColumn("rb", F.row_number().over(wb)).filter("ra = 1 and rb = 1").drop("ra", "rb")
        best = settled(best)
        out = best if out is None else out.unionByName(best)
        rest = settled(rest.join(best.select("a_id"), "a_id", "left_anti").join(best.select("b_id"), "b_id", "left_anti"))
    last, seen_a, seen_b = [], set(), set()
    for r in sorted(rest.collect(), key=lambda r: (-r.confidence, r.gap, r._tie, r.a_id, r.b_id)):
        if r.a_id not in seen_a and r.b_id not in seen_b:
            last.append(r)
            seen_a.add(r.a_id)
            seen_b.add(r.b_id)
    last = pairs.sparkSession.createDataFrame(last, rest.schema)
    return (last if out is None else out.unionByName(last)).drop("_tie")


def linked(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, confidence) of the links between two tables with the columns id, day, loc, state, lat, lon, tail, make, model, phase, persons, office.

    Any of them but id may be null; rows of one table are never linked with each other; a record has one partner at most; an empty table gives no links. Rows
    must be unique by id, and the tables settled, since every pass reads them. Links below the confidence LEAST are left out.
    """
    pairs = scored(settled(candidates(a, b)), a, b)
    good = pairs.filter(F.col("confidence") >= LEAST).withColumn("gap", -sum((F.greatest(F.col(c), F.lit(0)) for c in LEVELS), F.lit(0)))
    return one_to_one(good).select("a_id", "b_id", "confidence")
