"""Vectors of documents from words trained on them."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled, small


def document_ids(df: DataFrame, text: str) -> DataFrame:
    """(text_id, n_rows): one row per different text, identified by its print, so that ids need no global order. Null texts are left out."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.md5(text).alias("text_id")).agg(F.count(F.lit(1)).alias("n_rows"))


#: Texts that one task of the training takes.
TEXTS_A_PART = 50_000


def trained(df: DataFrame, text: str, size: int = 20, window: int = 3, seed: int = 42, least: int = 2, parts: int | None = None, different: int | None = None):
    """A word model over the different texts of the column; the same one each time for a seed and number of parts, which by default follows from the number of texts.

    different: the number of texts with words, if all are known to differ (`repeats`); they aren't compared and counted again then.
    """
    one = df.filter(F.col(text).isNotNull()).select(text)
    words = (one if different is not None else one.distinct()).select(T.spaced_tokens(F.col(text)).alias("words")).filter(F.size("words") > 0)
    parts = parts or max(1, -(-(words.count() if different is None else different) // TEXTS_A_PART))
    return Word2Vec(vectorSize=size, windowSize=window, seed=seed, minCount=least, numPartitions=parts, maxIter=1, inputCol="words", outputCol="v").fit(words)


def repeats(df: DataFrame, key: str, texts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """(what, key): the rows of df whose text of that name stands in a row of a smaller key too; and how many different texts with words each name has.

    Only prints of the texts are shuffled, for all names at once. key must be unique and not null; null texts are in neither.
    """
    with_words = {what: t.rlike("[^ \\t\\n\\r\\f\\x0B]") for what, t in texts.items()}
    prints = F.array(*[F.struct(F.lit(what).alias("what"), F.when(with_words[what], F.unhex(F.md5(t))).alias("_p")) for what, t in texts.items()])
    p = df.select(F.col(key), F.explode(prints).alias("_r")).select(key, "_r.*").filter("_p is not null")
    many = settled(p.groupBy("what", "_p").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    more = {r["what"]: r["n"] for r in many.groupBy("what").agg(F.sum(F.col("_n") - 1).alias("n")).collect()}
    every = df.agg(*[F.count_if(c).alias(what) for what, c in with_words.items()]).first()
    again = settled(p.join(small(many), ["what", "_p"]).filter(F.col(key) > F.col("_first")).select("what", key))
    return again, {what: every[what] - more.get(what, 0) for what in texts}


def document_vectors(df: DataFrame, text: str, model, out: str = "vector") -> DataFrame:
    """df with the mean vector of its words as an array; a text without known words has a zero vector, a null text a null."""
    from pyspark.ml.functions import vector_to_array

    d = df.withColumn("words", T.spaced_tokens(F.coalesce(F.col(text), F.lit(""))))
    return model.transform(d).withColumn(out, F.when(F.col(text).isNotNull(), vector_to_array("v"))).drop("words", "v")
