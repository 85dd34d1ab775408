"""Panels of entity and month: dense calendars, own / outside / overall totals, lagged windows, ratios."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(facts: DataFrame, entities: DataFrame, first: int, last: int, measures: list[str], fill: int | None = None) -> DataFrame:
    """(entity, month_idx, measures) for every entity and month from first to last; months without facts hold fill.

    facts: one row per entity and month_idx. The calendar is generated from each entity's row, without a cross join. Facts outside the entities or months are left out.
    """
    grid = entities.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("month_idx"))
    out = grid.join(facts.select("entity", "month_idx", *measures), ["entity", "month_idx"], "left")
    return out.fillna(fill, measures) if fill is not None else out


def own_out_all(panel: DataFrame, measures: list[str], by: list[str] = []) -> DataFrame:
    """panel with `_all`, the month's total over entities (of the same by), and `_out`, the total without the row's own.

    Totals are summed by month first and joined back, so that no month is gathered in one task; null own values count as 0 in `_out`, and a month without values has null totals.
    """
    totals = panel.groupBy("month_idx", *by).agg(*[F.sum(c).alias(f"{c}_all") for c in measures])
    out = panel.join(totals, ["month_idx", *by])
    return out.select(*panel.columns, *[x for c in measures for x in (F.col(f"{c}_all"), (F.col(f"{c}_all") - F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_out"))])


def label(n: int | None) -> str:
    """How a window is called in column names."""
    return "atime" if n is None else f"{n}m"


def frame(n: int | None, lag: int) -> "Window":
    """The months from n + lag - 1 before to lag before, of one entity; all before for no n."""
    w = Window.partitionBy("entity").orderBy("month_idx")
    return w.rangeBetween(Window.unboundedPreceding if n is None else -(n + lag - 1), -lag)


def lagged(panel: DataFrame, measures: list[str], windows: list[int | None], lag: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Sums over trailing windows of complete months: null where any month of the window is missing or null.

    panel must be dense. A window without end is complete if all months since the entity's first are. All windows share one sort by entity.
    """
    first = F.min("month_idx").over(Window.partitionBy("entity"))
    cols: list[Column] = []
    for n in windows:
        w = frame(n, lag)
        need = F.lit(n) if n is not None else F.greatest(F.lit(1), F.col("month_idx") - lag - first + 1)
        cols += [F.when(F.count(c).over(w) == need, F.sum(c).over(w)).alias(f"{c}_{label(n)}") for c in measures]
    return panel.select("entity", "month_idx", *(keep or []), *cols)


def ratios(df: DataFrame, pairs: dict[str, tuple[str, str]], digits: int = 6) -> DataFrame:
    """df with quotients name -> (numerator, denominator); null where the denominator is 0 or null."""
    return df.select("*", *[F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias(k) for k, (a, b) in pairs.items()])


def lagged_arrays(values: np.ndarray, windows: list[int], lag: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """As lagged, for the months of one entity as an array (measures, months) without gaps or nulls: for each window the sums and which months are complete, which holds for all measures."""
    months = values.shape[1]
    upto = np.zeros((values.shape[0], months + 1), np.int64)
    np.cumsum(values, axis=1, out=upto[:, 1:])
    at, out = np.arange(months), []
    for n in windows:
        begin, end = at - (n + lag - 1), at - lag + 1
        ok = (begin >= 0) & (end <= months)
        out.append((upto[:, end.clip(0, months)] - upto[:, begin.clip(0, months)], ok))
    return out


def rounded_ratios(a: np.ndarray, b: np.ndarray, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """As ratios, for arrays of whole numbers of 0 or more: the quotients, half up in their decimal form as Spark rounds, and where they exist (b isn't 0)."""
    ok = b != 0
    x = np.divide(a.astype(np.float64), b.astype(np.float64), out=np.zeros(a.shape), where=ok)
    scale = float(10**digits)
    y = x * scale
    down = np.floor(y)
    out = (down + (y - down > 0.5)) / scale
    near = np.abs(y - down - 0.5) <= 1e-6 + y * 1e-15  # the product may be off by a few last bits
    if near.any():
        each, where = np.unique(x[near], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[near] = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in each.tolist()])[where.reshape(-1)]
    return out, ok


def united(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of any number of frames on the same keys, which come out once; a column that several frames have is taken from the first."""
    out, have = frames[0], set(frames[0].columns)
    for f in frames[1:]:
        out = out.join(f.select(*keys, *[c for c in f.columns if c not in have]), keys, "full")
        have |= set(f.columns)
    return out


def widened(long: DataFrame, keys: list[str], name: str, values: list[str], measure: str) -> DataFrame:
    """One column per named value of the long form; the values are given, so that no job looks for them."""
    return long.groupBy(*keys).pivot(name, values).agg(F.sum(measure))


def lagged_distinct(words: DataFrame, n: int, lag: int, last: int) -> DataFrame:
    """(entity, month_idx, n_words): distinct words of the n months that end lag before. words: (entity, month_idx, word).

    Each word stands for the months it reaches, first made distinct; a window can't count distinct values.
    """
    own = words.select("entity", "month_idx", "word").distinct()
    at = own.select("entity", F.explode(F.sequence(F.col("month_idx") + lag, F.col("month_idx") + lag + n - 1)).alias("month_idx"), "word").filter(F.col("month_idx") <= last)
    return at.distinct().groupBy("entity", "month_idx").agg(F.count(F.lit(1)).alias("n_words"))


def coverage(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n_rows) of every column."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"), F.col("_n").alias("n_rows")) for c in df.columns])
    return one.select(F.explode(pairs).alias("r")).select("r.*")
