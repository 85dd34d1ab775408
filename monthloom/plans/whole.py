"""The whole wide report: the panel of wide.py with the words, dictionaries, categories and vectors of all five text columns.

Each text column is counted in long form, an entity being the pair of entity and column, so that all columns share the shuffles and the sort of the windows; an entity's
months are put together as arrays at the end. Words are clean tokens in lower case. Distinct words aren't counted; the source system's own run leaves them out.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import text
from ..operators import embedding, lookup, panel, tokens, vectors
from ..session import settled, small, stored
from . import panels, wide
from .wide import FIRST, LAST, WINDOWS

FIELDS = list(text.SHORT_NAMES.values())
SETS = ["abrvs", "pos_nonword", *panels.DICTS]
GROUPS = sorted({c for c, _ in panels.CATEGORIES})
#: Measures of each text column: words, words of the abbreviation dictionaries, words of the categories as written and with abbreviations written out.
MEASURES = ["wc", *SETS, *[f"lwc_{g}" for g in GROUPS], *[f"lwc_{g}_ff" for g in GROUPS]]
SCOPES = ["", "out", "all"]
#: Similarities of the vectors of texts and how their columns are called; their numbers of texts come with them.
SIMS = {"own_sim": "trcn", "out_sim": "trcn_out", "invall_sim": "trcn_invall", "n": "trcn_ct", "n_out": "trcn_out_ct"}
DIMS = 20
KEYS = ["entity", "month_idx"]


#: The text columns, as written and with abbreviations written out (`_ff`).
WRITINGS = [f + end for f in FIELDS for end in ("", "_ff")]
#: Models that are trained at a time; each has a task for every so many texts only.
AT_ONCE = 4


def _cleaned(reports: DataFrame, full: DataFrame) -> DataFrame:
    """(acn, entity, month_idx, clean words of the text columns but the narrative with its synopsis, which `_text` puts together, in both writings)."""
    own = {short: text.cleaned(F.lower(F.col(c))).alias(short) for c, short in text.SHORT_NAMES.items() if short != "nrsy"}
    d = reports.select("acn", F.col("facility_code").alias("entity"), "month_idx", *own.values())
    for f in own:
        d = tokens.expanded(d, f, full, f"{f}_ff")
    return d


def _text(what: str) -> Column:
    """One text of `_cleaned`; the narrative with its synopsis is null only if both are."""
    if not what.startswith("nrsy"):
        return F.col(what)
    a, b = (F.col(what.replace("nrsy", f)) for f in ("narr", "syn"))
    return F.when(F.coalesce(a, b).isNotNull(), F.trim(F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))))


def _long(cleaned: DataFrame) -> DataFrame:
    """(entity, month_idx, field, text), an entity being the pair of entity and column."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _text(f).alias("text")) for f in FIELDS])).alias("t")
    return cleaned.select("entity", "month_idx", each).select(F.struct("entity", F.col("t.field").alias("field")).alias("entity"), "month_idx", "t.field", "t.text")


def _of_fields(entities: DataFrame, fields: list[str]) -> DataFrame:
    return entities.select(F.explode(F.array(*[F.struct("entity", F.lit(f).alias("field")) for f in fields])).alias("entity"))


def word_facts(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    """(entity, month_idx, n_reports, MEASURES) of texts (entity, month_idx, field, text)."""
    counts = settled(tokens.word_counts(texts, "text", KEYS))
    tags = settled(panels.tagged_words(spark, sf, counts.select("word").distinct()))
    groups = spark.createDataFrame(panels.CATEGORIES, "category string, word string")
    named = lambda end: groups.select(F.concat(F.lit("lwc_"), "category", F.lit(end)).alias("kind"), "word")
    sets = tokens.dictionary_sets(tags, panels.DICTS).withColumnRenamed("dict", "kind").unionByName(named(""))
    out = F.explode(F.split(F.coalesce("fullform", "word"), " ")).alias("word")
    full = counts.join(small(tokens.replacements(tags).groupBy("word").agg(F.min("fullform").alias("fullform"))), "word", "left").select(*KEYS, out, "ct")
    kinds = tokens.dictionary_counts(counts, KEYS, sets, "kind").unionByName(tokens.dictionary_counts(full, KEYS, named("_ff"), "kind"))
    wide_kinds = panel.widened(kinds, KEYS, "kind", MEASURES[1:], "n_words")
    facts = texts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_reports"))
    facts = facts.join(counts.groupBy(*KEYS).agg(F.sum("ct").alias("wc")), KEYS, "left").join(wide_kinds, KEYS, "left")
    return facts.fillna(0, MEASURES)


KEPT = ["n_reports", *MEASURES]
SCOPED = wide.column_names([KEPT, SCOPES])


def word_panel(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, month_idx, field, SCOPED): the dense months of facts with their totals."""
    d = panel.dense(facts, _of_fields(entities, FIELDS), FIRST, LAST, KEPT, 0).withColumn("field", F.col("entity.field"))
    return panel.own_out_all(d, KEPT, ["field"])


def window_columns() -> tuple[list[str], dict[str, tuple[str, str]]]:
    """The names of the windows of SCOPED, and of their quotients with what is divided by what: averages per report and shares of the words."""
    quotients = {}
    for n in WINDOWS:
        name = lambda *p: wide.column_names([[x] for x in [*p, f"{n}m"]])[0]
        for m in MEASURES:
            for s in SCOPES:
                quotients[name(m, s, "avg")] = (name(m, s), name("n_reports", s))
                quotients[name(m, s, "pr")] = (name(m, s), name("wc", "all" if m == "wc" else s))
    return [f"{c}_{n}m" for n in WINDOWS for c in SCOPED], quotients


def _vector_sums(corpus: DataFrame, different: int, texts: DataFrame) -> DataFrame | None:
    """Sums of the unit vectors of texts by a model of the corpus, of so many different texts, both of one column; none if no word stands twice in it."""
    try:
        model = embedding.trained(corpus, "text", DIMS, different=different)
    except IllegalArgumentException as e:
        if "vocabulary size" not in str(e):
            raise
        return None
    return settled(vectors.unit_sums(embedding.document_vectors(texts, "text", model), KEYS, "vector", DIMS))


def text_sums(cleaned: DataFrame, chosen: DataFrame) -> list[DataFrame]:
    """(entity, month_idx, n, s) of the chosen rows of cleaned for each writing, by models trained on the different texts of all rows; several are trained at a time."""
    again, different = embedding.repeats(cleaned, "acn", {w: _text(w) for w in WRITINGS})
    again = small(again)

    def sums(w: str) -> DataFrame | None:
        corpus = cleaned.select("acn", _text(w).alias("text")).filter("text is not null").join(again.filter(F.col("what") == w).select("acn"), "acn", "left_anti")
        return _vector_sums(corpus, different[w], chosen.select(F.struct("entity", F.lit(w).alias("field")).alias("entity"), "month_idx", _text(w).alias("text")))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x for x in pool.map(inheritable_thread_target(cleaned.sparkSession)(sums), WRITINGS) if x is not None]


def similarities(parts: list[DataFrame], entities: DataFrame, lag: int) -> DataFrame:
    """(entity, month_idx, what, SIMS): mean cosines of the texts of each column, writing and window (`what`), from text_sums. Windows that begin before the first month have no rows."""
    grid = _of_fields(entities, WRITINGS).select("entity", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))).alias("month_idx"))
    zero = F.array(*[F.lit(0.0)] * DIMS)
    every = parts[0] if parts else grid.limit(0).select("entity", "month_idx", F.lit(0).cast("long").alias("n"), zero.alias("s"))
    for p in parts[1:]:
        every = every.unionByName(p)
    monthly = settled(grid.join(every, KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", zero).alias("s")))
    found = None
    for n in WINDOWS:
        got = vectors.similarities(vectors.lagged_sums(monthly, DIMS, n, lag).withColumn("field", F.col("entity.field")), DIMS, ["field", "month_idx"])
        got = got.filter(F.col("month_idx") - (n + lag - 1) >= FIRST).select(F.col("entity.entity"), "month_idx", F.concat("field", F.lit(f"_{n}m")).alias("what"), *SIMS)
        found = got if found is None else found.unionByName(got)
    return found


def spread(base: DataFrame, words: DataFrame, sims: DataFrame, lag: int) -> DataFrame:
    """One row per entity and month: base, the windows of words and their quotients for each text column, and the similarities.

    All three come as rows of one long table; an entity's months are put together at once, as arrays, so that no plan works on the thousands of columns.
    """
    wholes = [c for c, t in base.dtypes if t in ("int", "bigint") and c not in KEYS]
    reals = [c for c, t in base.dtypes if t == "double"]
    longs = lambda cs: F.array(*[F.col(c).cast("long") for c in cs])
    doubles = lambda cs: F.array(*[F.col(c).cast("double") for c in cs])
    real_sims, whole_sims = [c for c in SIMS if not c.startswith("n")], [c for c in SIMS if c.startswith("n")]
    long = base.select(*KEYS, F.lit("").alias("part"), longs(wholes).alias("wholes"), doubles(reals).alias("reals"))
    long = long.unionByName(words.select(F.col("entity.entity"), "month_idx", F.col("field").alias("part"), longs(SCOPED).alias("wholes"), F.array().cast("array<double>").alias("reals")))
    long = settled(long.unionByName(sims.select(*KEYS, F.col("what").alias("part"), longs(whole_sims).alias("wholes"), doubles(real_sims).alias("reals"))))

    windowed, quotients = window_columns()
    shown = [c for c in windowed if not c.startswith("n_reports")]
    place = {c: i for i, c in enumerate(windowed)}
    above, below = ([place[x[i]] for x in quotients.values()] for i in (0, 1))
    kinds = dict(base.dtypes)
    fields = [("entity", "string"), ("year", "int"), ("month", "int"), *[(c, kinds[c]) for c in base.columns if c not in KEYS]]
    for f in FIELDS:
        fields += [(f"{f}_{c}", "bigint") for c in shown] + [(f"{f}_{c}", "double") for c in quotients]
    whats = [f"{w}_{n}m" for w in WRITINGS for n in WINDOWS]
    fields += [(f"{k}_{w}", "double" if c in real_sims else "bigint") for w in whats for c, k in SIMS.items()]
    arrow = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t]) for c, t in fields])
    months = LAST - FIRST + 1

    def run(t: pa.Table) -> pa.Table:
        parts = t["part"].to_numpy(zero_copy_only=False)
        at = t["month_idx"].to_numpy() - FIRST

        def values(part: str, column: str, width: int, kind) -> tuple[np.ndarray, np.ndarray]:
            """Values (width, months) and where there are none."""
            rows = np.flatnonzero(parts == part)
            flat = pc.list_flatten(t[column].take(pa.array(rows))).combine_chunks()
            out, none = np.zeros((width, months), kind), np.ones((width, months), bool)
            none[:, at[rows]] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).T
            out[:, at[rows]] = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width).T
            return out, none

        month = np.arange(FIRST, LAST + 1)
        cols = [pa.array([t["entity"][0].as_py()] * months, pa.string()), pa.array((month - 1) // 12, pa.int32()), pa.array((month - 1) % 12 + 1, pa.int32())]
        own = {}
        for names, column, kind in ((wholes, "wholes", np.int64), (reals, "reals", np.float64)):
            out, none = values("", column, len(names), kind)
            own |= {c: pa.array(out[i], arrow.field(c).type, mask=none[i]) for i, c in enumerate(names)}
        cols += [own[c] for c in base_columns]
        for f in FIELDS:
            got = panel.lagged_arrays(values(f, "wholes", len(SCOPED), np.int64)[0], WINDOWS, lag)
            sums, none = np.concatenate([x for x, _ in got]), np.concatenate([np.broadcast_to(~ok, x.shape) for x, ok in got])
            shares, there = panel.rounded_ratios(sums[above], sums[below])
            gone = none[above] | none[below] | ~there
            cols += [pa.array(sums[place[c]], mask=none[place[c]]) for c in shown] + [pa.array(x, mask=m) for x, m in zip(shares, gone)]
        for w in whats:
            (x, no_x), (n, no_n) = values(w, "reals", len(real_sims), np.float64), values(w, "wholes", len(whole_sims), np.int64)
            cols += [pa.array(x[real_sims.index(c)], mask=no_x[real_sims.index(c)]) if c in real_sims else pa.array(n[whole_sims.index(c)], mask=no_n[whole_sims.index(c)]) for c in SIMS]
        return pa.Table.from_arrays(cols, schema=arrow)

    base_columns = [c for c in base.columns if c not in KEYS]
    return long.groupBy("entity").applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in fields))


def final_wide_whole(spark: SparkSession, sf: str, lag: int = 1) -> DataFrame:
    """final_wide with the windows of the words and the similarities of all text columns; columns of a text column start with its short name, similarities with `trcn`. Every readable date counts."""
    listed = spark.createDataFrame(sorted({(w,) for _, w, _ in panels.DICTIONARIES}), "word string")
    full = settled(tokens.replacements(panels.tagged_words(spark, sf, listed)))
    with stored(_cleaned(wide.reports(spark, sf, every=True), full)) as cleaned:
        n_words = F.when(F.coalesce("narr", F.lit("")) == "", 0).otherwise(F.size(F.split("narr", " ")))
        counted = cleaned.select(F.col("entity").alias("facility_code"), "month_idx", n_words.alias("n_words"), F.col("call").isNotNull().alias("with_callback"))
        base, entities = wide.report_windows(spark, sf, lag, every=True, counted=counted)
        chosen = lookup.allowed(cleaned.filter("month_idx is not null"), "entity", entities)
        words = word_panel(settled(word_facts(spark, sf, _long(chosen))), entities)
        return spread(base, words, similarities(text_sums(cleaned, chosen), entities, lag), lag)


def final_wide_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells of each column of the whole wide report are null."""
    return panel.coverage(settled(final_wide_whole(spark, sf)))


QUERIES = {f.__name__: f for f in (final_wide_whole, final_wide_coverage)}
