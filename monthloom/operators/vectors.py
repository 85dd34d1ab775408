"""Mean cosine within and between groups of vectors, from sums of unit vectors instead of pairs.

The sum of all cosines of two groups is the dot product of their summed unit vectors; so a group costs one pass and a few numbers, whatever its number of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_sums(df: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """(keys, n, s): number of vectors and the sum of their unit vectors; a zero vector adds nothing but counts. Null vectors are left out."""
    d = df.filter(F.col(vector).isNotNull()).select(*keys, F.col(vector).alias("_v"), F.nullif(norm(F.col(vector)), F.lit(0.0)).alias("_n"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.sum(F.col("_v")[i].cast("double") / F.col("_n")), F.lit(0.0)) for i in range(dims)]).alias("s"))


def _sum_of(arrays: Column, dims: int) -> Column:
    return F.aggregate(arrays, F.array(*[F.lit(0.0)] * dims), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))


def _within(s: Column, n: Column) -> Column:
    """Mean over unordered pairs, from [-1, 1] to [0, 1]; null below two vectors."""
    pairs = n * (n - 1) / 2
    return F.when(n >= 2, (1 + ((dot(s, s) - n) / 2) / pairs) / 2)


def similarities(sums: DataFrame, dims: int, by: list[str] = [], digits: int = 6) -> DataFrame:
    """sums (entity, by, n, s) with own, out, invall, invout: the mean cosine within the entity, among all others, between it and all, between it and the others."""
    total = [F.sum("n").alias("n_all"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s_all")]
    if by:
        d = sums.join(sums.groupBy(*by).agg(*total), by)
    else:
        d = sums.select("*", *[sums.agg(t).scalar().alias(n) for t, n in zip(total, ("n_all", "s_all"))])
    d = d.withColumn("n_out", F.col("n_all") - F.col("n")).withColumn("s_out", F.zip_with("s_all", "s", lambda a, b: a - b))
    scaled = lambda x, pairs: F.when(pairs > 0, (1 + x / F.nullif(pairs, F.lit(0))) / 2)
    cols = {"own_sim": _within(F.col("s"), F.col("n")), "out_sim": _within(F.col("s_out"), F.col("n_out")), "invall_sim": scaled(dot(F.col("s"), F.col("s_all")), F.col("n") * F.col("n_all")), "invout_sim": scaled(dot(F.col("s"), F.col("s_out")), F.col("n") * F.col("n_out"))}
    return d.select("entity", *by, "n", "n_out", *[F.round(c, digits).alias(k) for k, c in cols.items()])


def with_pairs(sims: DataFrame) -> DataFrame:
    """similarities with the numbers of pairs they are means of."""
    pairs = lambda n: F.floor(n * (n - 1) / 2).cast("long")
    return sims.withColumns({"own_pairs": pairs(F.col("n")), "out_pairs": pairs(F.col("n_out")), "invall_pairs": (F.col("n") * (F.col("n") + F.col("n_out"))).cast("long")})


def lagged_sums(sums: DataFrame, dims: int, n: int, lag: int) -> DataFrame:
    """sums (entity, month_idx, n, s), dense, over the n months that end lag before; empty windows have n 0 and a zero vector."""
    w = Window.partitionBy("entity").orderBy("month_idx").rangeBetween(-(n + lag - 1), -lag)
    return sums.select("entity", "month_idx", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.array(*[F.coalesce(F.sum(F.col("s")[i]).over(w), F.lit(0.0)) for i in range(dims)]).alias("s"))
