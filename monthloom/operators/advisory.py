"""Facilities named in advisory strings: extraction, residue, classes, expansion to one row per facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

# Facility types and suffixes as reports write them, and how long a code may be.
TYPES = ["Center", "Tower", "TRACON", "FSS", "Ground", "Ramp", "CTAF", "UNICOM", "Military Facility"]
SUFFIXES = [".ARTCC", ".Tower", ".FSS", ".TRACON", ".MILFAC", "&.Tower", ".UNICOM"]
PATTERN = "(" + "|".join(TYPES) + ") ([A-Za-z0-9]{2,10})(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")?"
# Words that are no residue on their own.
REMAINS = ["TRACON", "Tower", ""]


def advisory(first: Column, second: Column) -> Column:
    """Two advisories in one string, null as empty, without a trailing separator."""
    return F.regexp_replace(F.concat(F.coalesce(first, F.lit("")), F.lit("; "), F.coalesce(second, F.lit(""))), "; $", "")


def facilities(text: Column) -> Column:
    """Array of (type, code, suffix) in order; a missing suffix is empty. Null gives null."""
    part = lambda i: F.regexp_extract_all(text, F.lit(PATTERN), F.lit(i))
    codes, suffixes = part(2), part(3)
    return F.transform(part(1), lambda t, i: F.struct(t.alias("type"), F.get(codes, i).alias("code"), F.coalesce(F.get(suffixes, i), F.lit("")).alias("suffix")))


def residue(text: Column, found: Column) -> Column:
    """The text without the facilities found; what holds only words of REMAINS is empty."""
    flat = F.replace(F.replace(F.replace(text, F.lit(" ; "), F.lit(" ")), F.lit("; "), F.lit(" ")), F.lit(" ;"), F.lit(" "))
    left = F.aggregate(found, flat, lambda s, e: F.replace(s, F.concat(e["type"], F.lit(" "), e["code"], e["suffix"]), F.lit("")))
    only = F.forall(F.split(left, " "), lambda w: w.isin(*REMAINS))
    return F.when(only, "").otherwise(left)


def by_code(df: DataFrame, key: str, found: str, codes: DataFrame, code: str) -> DataFrame:
    """(key, listed, others): the facilities of a document whose code is on the list, and the others, each in order. Documents without facilities get two empty arrays; rows of one key are one document."""
    slot = df.select(key, F.posexplode_outer(found).alias("pos", "e"))
    known = small(codes.select(F.col(code).alias("_code")).filter("_code is not null").distinct().withColumn("_on", F.lit(True)))
    slot = slot.join(known, F.col("e.code") == F.col("_code"), "left")
    part = lambda on: F.transform(F.sort_array(F.collect_list(F.when(F.col("e").isNotNull() & (F.coalesce("_on", F.lit(False)) == on), F.struct("pos", "e")))), lambda x: x["e"])
    return slot.groupBy(key).agg(part(True).alias("listed"), part(False).alias("others"))


def slots(found: Column, prefix: str, n: int = 6) -> list[Column]:
    """Numbered columns type, code, repeated of the first n facilities; empty text for none. repeated: whether a suffix is there."""
    out = []
    for i in range(n):
        e = F.get(found, F.lit(i))
        out += [F.coalesce(e["type"], F.lit("")).alias(f"{prefix}_type{i}"), F.coalesce(e["code"], F.lit("")).alias(f"{prefix}_code{i}"), (F.coalesce(e["suffix"], F.lit("")) != "").alias(f"{prefix}_repeated{i}")]
    return out


def per_code(df: DataFrame, key: str, found: str) -> DataFrame:
    """(key, code, ident_type, n_codes): one row per document and distinct code; the first facility of a code decides its type, n_codes is the number of its types.

    Documents without any facility keep one row with a null code; those whose facilities all lack a code are dropped.
    """
    slot = df.select(key, F.posexplode(found).alias("pos", "e")).select(key, "pos", "e.type", "e.code")
    pairs = slot.filter("code != ''").groupBy(key, "code", "type").agg(F.min("pos").alias("pos"))
    codes = pairs.groupBy(key, "code").agg(F.min_by("type", "pos").alias("ident_type"), F.count(F.lit(1)).alias("n_codes"))
    none = df.filter(F.coalesce(F.size(found), F.lit(0)) <= 0).select(key, F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("ident_type"), F.lit(0).cast("long").alias("n_codes"))
    return codes.unionByName(none)


def type_counts(df: DataFrame, key: str, found: str, types: list[str] = TYPES) -> DataFrame:
    """Per document one count per type, over distinct (code, type)."""
    slot = df.select(key, F.explode(found).alias("e")).select(key, "e.type", "e.code").filter("code != ''").distinct()
    return slot.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(t.lower().replace(" ", "_") + "_ident_ct") for t in types])


def frequency(df: DataFrame, found: str, field: str) -> DataFrame:
    """(value, ct) of a field of the facilities, empty ones left out."""
    return df.select(F.explode(found).alias("e")).select(F.col(f"e.{field}").alias("value")).filter("value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("ct"))
