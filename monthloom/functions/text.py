"""Words of texts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of the text columns, and the patterns that clean a word, each with the group that is kept, first match first.
SHORT_NAMES = {"narrative": "narr", "synopsis": "syn", "narrative_synopsis_combined": "nrsy", "combined": "all", "callback": "call"}
CLEANING = [
    (r"^([('\[\]])([A-Za-z0-9]+)([('\[\]])$", 2),
    (r"^([('\[])([A-Za-z0-9]+)$", 2),
    (r"^([A-Za-z0-9]+)([)'\]])$", 1),
    (r"^([A-Za-z]+)([?:])$", 1),
    (r"^([A-Za-z]+)/([A-Za-z]+)$", 1),
]
#: The statistics' own forms of the same patterns; the third differs.
SHARE_PATTERNS = [r"^[('\[][A-Za-z0-9]+$", r"^[A-Za-z0-9]+[)'\]]$", r"^[('\[][A-Za-z0-9]+[('\[]$", r"^[A-Za-z]+[?:]$", r"^[A-Za-z]+/[A-Za-z]+$"]


def clean_tokens(text: Column) -> Column:
    """The 32 ASCII punctuation marks become blanks; split on the blank only, so tabs and line breaks stay inside tokens."""
    return F.filter(F.split(F.regexp_replace(text, r"\p{Punct}", " "), " "), lambda t: t != "")


def spaced_tokens(text: Column) -> Column:
    """Split on ASCII white space."""
    return F.array_remove(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), "")


def cleaned(text: Column) -> Column:
    """The clean tokens joined by one blank each, in one pass over the text."""
    return F.trim(F.regexp_replace(text, r"[\p{Punct} ]+", " "))


def word_count(text: Column) -> Column:
    """Number of clean tokens; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(clean_tokens(text)))


def joined(*texts: Column) -> Column:
    """Texts in a row in lower case, null as empty."""
    parts: list[Column] = []
    for t in texts:
        parts += [F.lit(" ")] * bool(parts) + [F.coalesce(t, F.lit(""))]
    return F.lower(F.concat(*parts))


def cleaned_word(word: Column) -> Column:
    """The word without bracket or trailing mark by the first pattern that fits, else null."""
    out = None
    for pattern, group in CLEANING:
        out = F.when(word.rlike(pattern), F.regexp_extract(word, pattern, group)) if out is None else out.when(word.rlike(pattern), F.regexp_extract(word, pattern, group))
    return out


def has_nonalpha(word: Column) -> Column:
    """Whether a word holds anything but ASCII letters; null counts as true."""
    return F.coalesce(word.rlike("[^A-Za-z]"), F.lit(True))
