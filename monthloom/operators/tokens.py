"""Words of documents: counts, dictionaries, tags, expansion, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled, small

#: Dictionaries up to this size are used as a map inside the expression, which is searched from its beginning for every word.
MAP_ENTRIES = 64


def word_counts(df: DataFrame, text: str, keys: list[str] = [], *, clean: bool = True, distinct_texts: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(keys, word, ct). distinct_texts: equal texts of all rows count once; the different texts are shuffled once for that. only: a table of the words (word) that are counted; others are left out before any shuffle."""
    if distinct_texts:
        df = df.select(*keys, text).dropDuplicates([*keys, text])
    split = T.clean_tokens(F.col(text)) if clean else T.spaced_tokens(F.col(text))
    words = df.select(*keys, F.explode(split).alias("word"))
    if only is not None:
        words = words.join(small(only.select("word").distinct()), "word", "left_semi")
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("ct"))


def dictionary_counts(counts: DataFrame, keys: list[str], words: DataFrame, name: str = "dict") -> DataFrame:
    """(keys, name, n_words, n_unique): occurrences and words of each word set. counts: one row per key and word. words: (name, word), made distinct."""
    w = small(words.select(name, "word").distinct())
    return counts.join(w, "word").groupBy(*keys, name).agg(F.sum("ct").alias("n_words"), F.count(F.lit(1)).alias("n_unique"))


def with_all_forms(vocabulary: DataFrame, dictionaries: DataFrame, names: list[str]) -> DataFrame:
    """vocabulary (word, ...) with one full-form column per dictionary, a row for every combination of full forms; equal rows once. Words in no dictionary keep one row."""
    for n in names:
        forms = dictionaries.filter(F.col("dict") == n).select(F.col("acronym").alias("word"), F.col("fullform").alias(n)).distinct()
        vocabulary = vocabulary.join(small(forms), "word", "left")
    return vocabulary.distinct()


def with_dictionaries(vocabulary: DataFrame, dictionaries: DataFrame, names: list[str]) -> DataFrame:
    """(word, ct, one full-form column per dictionary): the smallest full form of each."""
    wide = dictionaries.groupBy(F.col("acronym").alias("word")).pivot("dict", names).agg(F.min("fullform"))
    return vocabulary.join(small(wide), "word", "left")


def flags(vocabulary: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """vocabulary with one flag per word list (a column word each); all lists are joined at once."""
    every = None
    for name, words in lists.items():
        part = words.select("word", F.lit(name).alias("_list"))
        every = part if every is None else every.unionByName(part)
    per_word = every.groupBy("word").agg(*[F.max(F.col("_list") == name).alias(name) for name in lists])
    return vocabulary.join(small(per_word), "word", "left").fillna(False, list(lists))


def tagged(v: DataFrame) -> DataFrame:
    """Words with tag and abrev (1 for abbreviations). v: word, ct, full forms nasa, faa, casa, hand, iata, hand2 and the flags english, stop, city, airport, hand_word, hand_abbrev.

    Words without any full form are `neg_`, those with one beside hand2 `pos_`; the first condition that holds decides. Words in hand2 only have an empty tag.
    """
    full = lambda c: F.col(c).isNotNull()
    pos = full("casa") | full("faa") | full("iata") | full("nasa") | full("hand")
    neg = ~pos & ~full("hand2")
    n = (
        F.when(F.col("stop"), "neg_stopword").when(F.col("english"), "neg_word").when(F.col("city"), "neg_nonword_city_exception").when(T.has_nonalpha(F.col("word")), "neg_nonalpha_abrev")
        .when(F.col("airport"), "neg_airport").when(F.col("hand_word"), "neg_word_hand2").otherwise("neg_nonword")
    )
    p = (
        F.when(F.col("english") & ~F.col("stop") & full("iata") & ~full("casa") & ~full("faa"), "pos_iata_only_words").when(F.col("hand_abbrev"), "pos_handcoded_abrev")
        .when(F.col("stop"), "pos_stopword").when(~F.col("english"), "pos_nonword").otherwise("pos_word")
    )
    tag = F.when(neg, n).when(pos, p).otherwise("")
    return v.withColumn("tag", tag).withColumn("abrev", F.col("tag").isin("neg_nonword", "pos_handcoded_abrev", "pos_nonword").cast("int"))


def tag_summary(t: DataFrame) -> DataFrame:
    """Per tag: occurrences, words, and their shares of all. Aggregated by tag before the totals, which so are over a few rows."""
    per = t.groupBy("tag").agg(F.sum("ct").alias("ct"), F.count(F.lit(1)).alias("n_unique"))
    total = lambda c: per.agg(F.sum(c)).scalar()
    return per.select("tag", "ct", "n_unique", F.round(F.col("ct") / total("ct"), 6).alias("share"), F.round(F.col("n_unique") / total("n_unique"), 6).alias("share_unique"))


def dictionary_summary(v: DataFrame, names: list[str]) -> DataFrame:
    """(dict, ct, n_unique) of the words each dictionary's column has a full form for, and of those that any has (`any`)."""
    conds = {n: F.col(n).isNotNull() for n in names}
    any_of = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    one = v.agg(*[x for n, c in [*conds.items(), ("any", any_of)] for x in (F.coalesce(F.sum(F.when(c, F.col("ct"))), F.lit(0)).alias(f"{n}_ct"), F.count_if(c).alias(f"{n}_n"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dict"), F.col(f"{n}_ct").alias("ct"), F.col(f"{n}_n").alias("n_unique")) for n in [*names, "any"]])).alias("r")).select("r.*")


def dictionary_sets(t: DataFrame, names: list[str]) -> DataFrame:
    """(dict, word): the abbreviations of each dictionary, all abbreviations (`abrvs`) and those not English (`pos_nonword`)."""
    sets = F.array_compact(F.array(F.when(F.col("abrev") == 1, "abrvs"), F.when(F.col("tag") == "pos_nonword", "pos_nonword"), *[F.when((F.col("abrev") == 1) & F.col(n).isNotNull(), n) for n in names]))
    return t.select(F.explode(sets).alias("dict"), "word").distinct()


def replacements(t: DataFrame) -> DataFrame:
    """(word, fullform) of the abbreviations: the first full form of nasa, faa, casa, hand, iata, in lower case."""
    return t.filter("abrev = 1").select("word", F.lower(F.coalesce("nasa", "faa", "casa", "hand", "iata")).alias("fullform")).filter("fullform is not null")


def expanded(df: DataFrame, text: str, table: DataFrame, out: str) -> DataFrame:
    """df with out, the text with its words (between white space) written out, joined by blanks. Null stays null.

    A table of up to MAP_ENTRIES rows becomes a map in the expression and costs no shuffle; a larger one is joined word by word.
    """
    rows = table.groupBy("word").agg(F.min("fullform").alias("fullform")).limit(MAP_ENTRIES + 1).collect()
    words = T.spaced_tokens(F.col(text))
    if not rows:
        return df.withColumn(out, F.array_join(words, " "))
    if len(rows) <= MAP_ENTRIES:
        m = F.map_from_arrays(F.array(*[F.lit(r.word) for r in rows]), F.array(*[F.lit(r.fullform) for r in rows]))
        return df.withColumn(out, F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)), " "))
    d = settled(df.withColumn("_row", F.monotonically_increasing_id()))  # both sides of the join must see the same numbers
    one = d.select("_row", F.posexplode(words).alias("_pos", "word")).join(table.groupBy("word").agg(F.min("fullform").alias("fullform")), "word", "left")
    back = one.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("fullform", "word").alias("w")))).alias("_ws"))
    return d.join(back, "_row", "left").withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce(F.array_join("_ws.w", " "), F.lit("")))).drop("_row", "_ws")


def pattern_shares(counts: DataFrame, patterns: list[str] = T.SHARE_PATTERNS) -> DataFrame:
    """One row: for each pattern the share of all occurrences whose word fits it."""
    total = F.sum("ct")
    return counts.agg(*[F.round(F.try_divide(F.sum(F.when(F.col("word").rlike(p), F.col("ct")).otherwise(0)), total), 6).alias(f"pattern_{i + 1}") for i, p in enumerate(patterns)], F.round(F.try_divide(F.sum(F.when(T.has_nonalpha(F.col("word")), F.col("ct")).otherwise(0)), total), 6).alias("nonalpha"))


def document_stats(df: DataFrame, keys: list[str], text: str, *, codes: str | None = None, flags: list[str] = [], idents: list[str] = []) -> DataFrame:
    """Per key: documents, words, words per document; if they are named, the mean of codes (codes of a document), how many documents meet each of flags and any of them, and the sums of idents with their total."""
    n = T.word_count(F.col(text))
    more = [F.round(F.avg(codes), 6).alias("avg_codes")] if codes else []
    if flags:
        either = F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in flags]) if len(flags) > 1 else F.col(flags[0])
        more += [*[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags], F.count_if(either).alias("n_any_flag")]
    if idents:
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        more += [*[F.sum(zero(c)).cast("long").alias(c) for c in idents], F.sum(sum((zero(c) for c in idents[1:]), zero(idents[0]))).cast("long").alias("n_idents")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("long").alias("n_words"), F.round(F.avg(n), 6).alias("avg_words"), *more)


def count_values(t: DataFrame) -> DataFrame:
    """Per tag: how many different numbers of occurrences its words have, and their share of the sum over tags."""
    per = t.groupBy("tag").agg(F.countDistinct("ct").alias("n_counts"))
    return per.select("tag", "n_counts", F.round(F.col("n_counts") / per.agg(F.sum("n_counts")).scalar(), 6).alias("share_counts"))
