"""Names, codes, places and coordinates of registers as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

# Words of airport names that are written out.
FULL_WORDS = {"rgnl": ["regional"], "fld": ["field"], "intl": ["international"], "muni": ["municipal"], "univ.": ["university"], "iap": ["international", "airport"], "afb": ["air", "force", "base"]}


def _full(words: Column) -> Column:
    table = F.create_map(*[x for k, v in FULL_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w))))


def clean_name(name: Column) -> Column:
    """Lower case, short words written out, one leading bracket or slash and one trailing bracket, slash, comma or dash taken off, words joined by dash or slash parted, lone dashes dropped. Null stays null."""
    words = F.filter(_full(F.split(F.lower(name), " ")), lambda w: w != "-")
    words = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^[(/]", ""), r"[)/,\-]$", ""))
    pair = r"^([a-z]+)[-/]([a-z]+)"
    parted = F.flatten(F.transform(words, lambda w: F.when(w.rlike(pair), F.array(F.regexp_extract(w, pair, 1), F.regexp_extract(w, pair, 2))).otherwise(F.array(w))))
    return F.array_join(_full(parted), " ")


def clean_code(code: Column) -> Column:
    """Texts for none taken out, upper case, trimmed; empty is null."""
    c = F.trim(code)
    for none in ("n/a", "none", "na"):
        c = F.replace(F.lower(c), F.lit(none), F.lit(""))
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def short_code(code: Column) -> Column:
    """A code of four letters that starts with K loses the K."""
    return F.when((F.length(code) == 4) & code.startswith("K"), F.substring(code, 2, 3)).otherwise(code)


def place_parts(place: Column) -> dict[str, Column]:
    """city, state, country of two or three parts between commas, in lower case; other texts give nulls."""
    part = F.split(place, ",")
    n = F.size(part)
    at = lambda i: F.lower(F.trim(F.get(part, F.lit(i))))
    return {"city": F.when(n.isin(2, 3), at(0)), "state": F.when(n.isin(2, 3), at(1)), "country": F.when(n == 3, at(2))}


def located(df: DataFrame, place: str, states: DataFrame, code: str, full: str) -> DataFrame:
    """df with city, state, country of a text of two or three parts between commas. The state of three parts is written out if the list knows its code, of two parts it is null unless the list does; a last part that is a
    listed code or USA means the United States. Other texts give nulls; the list is made unique by code (smallest name)."""
    part = F.split(F.col(place), ",")
    n = F.size(part)
    named = small(states.groupBy(F.col(code).alias("_code")).agg(F.min(full).alias("_full")))
    d = df.withColumns({"_second": F.when(n.isin(2, 3), F.trim(F.get(part, F.lit(1)))), "_last": F.when(n >= 2, F.trim(F.element_at(part, -1)))})
    d = d.join(named, F.col("_second") == F.col("_code"), "left").drop("_code").withColumnRenamed("_full", "_state")
    d = d.join(named, F.col("_last") == F.col("_code"), "left").withColumnRenamed("_full", "_at_home")
    city = F.when(n.isin(2, 3), F.trim(F.lower(F.get(part, F.lit(0)))))
    state = F.when(n == 3, F.coalesce("_state", "_second")).when(n == 2, F.col("_state"))
    country = F.when(F.col("_at_home").isNotNull() | (F.col("_last") == "USA"), "United States").otherwise(F.col("_last"))
    return d.withColumns({"city": city, "state": state, "country": country}).drop("_second", "_last", "_state", "_at_home", "_code")


def coordinate(text: Column) -> Column:
    """A number rounded to five places, else null."""
    return F.round(F.trim(text).try_cast("double"), 5)
