"""Rows that fail to parse: one anchored pattern for whole rows, field-prefix patterns for the reason.

A schema is a list of fields, each with a name and a pattern its value must match. From it an anchored pattern for whole valid rows is
generated; only rows that fail it go through the patterns that grow field by field and find the first broken rule. All
patterns run in the JVM, use possessive or disjoint classes only and so never backtrack over long lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks around a field.
_S = r"[ \t\r]*"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BARE = r'[^"|]*'


@dataclass(frozen=True)
class Field:
    """A field of a raw row. value: the pattern of the trimmed, unquoted value, or None for any text; it must hold no quote, pipe or group that captures."""

    name: str
    value: str | None = None
    reason: str | None = None


#: A plain decimal number from -90 to 90.
LATITUDE = r"(?:[+-]?(?:0*(?:90(?:\.0*)?|[0-8]?[0-9](?:\.[0-9]*)?)|\.[0-9]+))?"
#: Empty, a word for none, or three or four ASCII letters or digits.
AIRPORT_CODE = r"(?:[nN]/[aA]|[nN][oO][nN][eE]|[A-Za-z0-9]{3,4})?"

#: The raw lines of register B, in their order.
REGISTER_B = [
    Field("airport_code", AIRPORT_CODE, "airport_code"),
    Field("airport_name"),
    Field("latitude", LATITUDE, "latitude"),
    Field("longitude"),
    Field("location"),
    Field("event_date"),
    Field("investigation_type"),
]


def any_field() -> str:
    """A well-quoted field of any text."""
    return rf'{_S}(?:{_QUOTED}{_S}|(?!{_S}"){_BARE})(?=\||\z)'


def _valid(f: Field) -> str:
    if f.value is None:
        return any_field()
    return rf'{_S}(?:"{_S}{f.value}{_S}"|{f.value}){_S}(?=\||\z)'


def row_pattern(schema: list[Field]) -> str:
    """The anchored pattern of a whole valid row."""
    return r"(?s)\A" + r"\|".join(_valid(f) for f in schema) + r"\z"


def layout_pattern(n: int | None = None) -> str:
    """The anchored pattern of a well-quoted row, of n fields if given."""
    more = "*+" if n is None else "{%d}" % (n - 1)
    return rf"(?s)\A{any_field()}(?:\|{any_field()}){more}\z"


def prefix_pattern(schema: list[Field], k: int) -> str:
    """The anchored pattern of a row whose k-th field is valid, whatever the others hold."""
    head = "".join(any_field() + r"\|" for _ in range(k))
    return r"(?s)\A" + head + _valid(schema[k])


def failure_reason(line: Column, schema: list[Field], order: list[str]) -> Column:
    """The first reason that applies to a line, or null for a valid one.

    `quoting` and `columns` come first, then the fields' own reasons in the given order. A null line counts as `columns`: it has no field.
    """
    reason = F.when(~line.rlike(layout_pattern()), "quoting").when(~line.rlike(layout_pattern(len(schema))), "columns")
    for name in order:
        k = next(i for i, f in enumerate(schema) if f.reason == name)
        reason = reason.when(~line.rlike(prefix_pattern(schema, k)), name)
    return F.when(line.isNull(), "columns").when(~line.rlike(row_pattern(schema)), reason)


def split_rows(df: DataFrame, line: str, schema: list[Field], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows with one text column per field, failed rows with a reason).

    Values are trimmed, enclosing quotes removed and doubled quotes made one; empty values are null. Extra columns of df stay in both;
    where a field's name clashes with one, the field comes out as `name_parsed`. Empty lines fail as `columns`; repeated lines are judged each for themselves; an empty table gives two empty tables.
    """
    judged = df.withColumn("_reason", failure_reason(F.col(line), schema, order))
    good = judged.filter("_reason is null")
    pieces = F.regexp_extract_all(F.concat(F.lit("|"), F.col(line)), F.lit(rf'(?s)\|({_S}(?:{_QUOTED}{_S}|{_BARE}))(?=\||\z)'), F.lit(1))
    taken = {c.lower() for c in df.columns}
    cols = []
    for i, f in enumerate(schema):
        v = F.trim(F.regexp_replace(F.element_at(pieces, i + 1), r"[\t\r]", " "))
        v = F.when(v.startswith('"'), F.trim(F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"')))).otherwise(v)
        cols.append(F.nullif(v, F.lit("")).alias(f.name + "_parsed" if f.name.lower() in taken else f.name))
    return good.select(*df.columns, *cols), judged.filter("_reason is not null").withColumnRenamed("_reason", "reason")
