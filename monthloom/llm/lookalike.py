"""Visually identical text brought to one form, on arrays of code points.

The Arrow buffer of a whole batch is decoded once into an array of code points. A lookup table says for each what it becomes: nothing
(marks that show nothing), one code point, or several (compatibility forms, canonical decompositions). Gathers and expansion offsets
apply it, runs of combining marks are put in canonical order, and base and mark are composed by a search in a sorted table of
pairs, all for the batch at once; no string function is called for a row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SALTS, settled, spread_lookup

# Letters of other alphabets (Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu, phonetic) that look like a Latin letter, by that letter; and dashes that look like a hyphen.
LOOKS = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "ϹСᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ͿЈᎫꓙ", "K": "ΚКᏦⲔꓗ", "L": "Ꮮꓡ", "M": "ΜϺМᎷⲘꓟ",
    "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢⲢꓑ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥУҮᎩⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "ɑαа", "c": "ϲсᴄⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һ", "i": "ıιі", "j": "ϳј", "l": "ӏ", "n": "ո", "o": "οоօᴏⲟ", "p": "ρрⲣ", "q": "ԛ", "s": "ѕꜱ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝᴡ",
    "x": "х", "y": "уү", "z": "ᴢ", "-": "‐‑−",
}
# Code points that show nothing.
HIDDEN = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFEFF, 0xFFA0]
HIDDEN_RANGES = [(0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF)]
#: Compatibility forms that look like what they stand for; others (raised, circled, fractions) are visibly different and stay.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}
# The first Hangul syllable, leading consonant, vowel and trailing consonant (less one), and how many of each there are.
SYLLABLE, LEADING, VOWEL, TRAILING = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADING, N_VOWELS, N_TRAILING = 19, 21, 28

_TOP = 0x110000


def _decomposed(cp: int) -> list[int]:
    """What a code point stands for, in full."""
    raw = unicodedata.decomposition(chr(cp))
    if not raw or 0x3131 <= cp <= 0x318E:  # a Hangul letter on its own doesn't look like part of a syllable
        return [cp]
    parts = raw.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK or (parts[1] == "0020" and len(parts) > 2):  # a spacing accent is no accent after a blank
            return [cp]
        parts = parts[1:]
    return [x for p in parts for x in _decomposed(int(p, 16))]


def confusables(path: str | None) -> tuple[tuple[int, int], ...]:
    """(code point, what it looks like) from a file in the form of the public confusables.txt (UTS #39): single code points beyond ASCII that look like a single one. None gives none.

    What ASCII characters look like among themselves (I and l, 0 and O) is a visible difference here and is left out.
    """
    if not path:
        return ()
    found = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            cells = [c.split() for c in line.partition("#")[0].split(";")]
            if len(cells) >= 2 and len(cells[0]) == len(cells[1]) == 1 and (cp := int(cells[0][0], 16)) >= 0x80:
                found[cp] = int(cells[1][0], 16)
    return tuple(sorted(found.items()))


@lru_cache(maxsize=4)
def tables(words_only: bool = False, more: tuple[tuple[int, int], ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(how many code points each becomes, where they begin, the code points themselves, the combining class of each code point).

    words_only: letters in lower case too, marks of accents kept, everything that is no letter or digit a blank. more: look-alikes beside LOOKS, as from confusables.
    """
    same = dict(more) | {ord(a): ord(b) for b, those in LOOKS.items() for a in those}
    hidden = {*HIDDEN, *(c for a, b in HIDDEN_RANGES for c in range(a, b + 1))}
    count, begin = np.ones(_TOP, np.uint8), np.arange(_TOP, dtype=np.int64)
    special: list[int] = []
    for cp in range(0x80 if not words_only else 0, 0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        if cp in hidden:
            count[cp] = 0
            continue
        to = [same.get(x, x) for x in _decomposed(same.get(cp, cp))]
        if words_only:
            to = [y for x in to for c in chr(x).lower() for y in (same.get(z, z) for z in _decomposed(ord(c)))]
            to = [x if chr(x).isalnum() or unicodedata.combining(chr(x)) else 32 for x in to]
        if to != [cp]:
            count[cp], begin[cp] = len(to), _TOP + len(special)
            special += to
    for a, b in HIDDEN_RANGES:
        count[a : b + 1] = 0
    ccc = np.zeros(_TOP, np.uint8)
    for cp in range(0x300, 0x1E950):
        if k := unicodedata.combining(chr(cp)):
            ccc[cp] = k
    return count, begin, np.concatenate([np.arange(_TOP, dtype=np.uint32), np.array(special, np.uint32)]), ccc


@lru_cache(maxsize=1)
def pairs() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys base << 21 | mark of all canonical compositions, and what they compose to."""
    found = {}
    for cp in range(0xC0, 0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        raw = unicodedata.decomposition(chr(cp))
        if raw and not raw.startswith("<") and len(p := raw.split()) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            found[int(p[0], 16) << 21 | int(p[1], 16)] = cp
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.uint32)


@lru_cache(maxsize=4)
def direct(words_only: bool = False, more: tuple[tuple[int, int], ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(what each code point becomes on its own, whether it needs more care): one that becomes nothing or several, or is or leaves a combining mark, needs care."""
    count, begin, flat, ccc = tables(words_only, more)
    to, odd = flat[np.where(count > 0, begin, 0)], count != 1
    keys, composed = pairs()
    for cp in np.flatnonzero(count == 2).tolist():  # a letter with its accent stays one
        x, y = flat[begin[cp] : begin[cp] + 2].tolist()
        k = np.searchsorted(keys, x << 21 | y)
        if ccc[y] and k < len(keys) and keys[k] == x << 21 | y:
            to[cp], odd[cp] = composed[k], False
    odd[VOWEL : VOWEL + N_VOWELS] = odd[TRAILING + 1 : TRAILING + N_TRAILING] = True  # they may join the letter before
    return to, odd | (ccc > 0) | (ccc[to] > 0)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows in a row, and where each row begins, with the end. Nulls have none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = offsets - offsets[0]
    if len(cps) != len(raw):
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])[at]
    return cps, at


def to_arrow(cps: np.ndarray, at: np.ndarray, valid: np.ndarray | None) -> pa.Array:
    """The reverse of code_points."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = at
    if len(data) != len(cps):
        width = (cps >= 0x80).view(np.uint8) + (cps >= 0x800).view(np.uint8) + (cps >= 0x10000).view(np.uint8)
        offsets = at + np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[at]
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data), mask)


def _marks(cps: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of combining marks, their classes, and the place of each one's base (-1 without one)."""
    at = np.flatnonzero((cps >= 0x300) & (ccc[cps] > 0))
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
    first = at[new][np.cumsum(new) - 1]
    base = first - 1
    base = np.where((base >= 0) & (row[np.maximum(base, 0)] == row[at]), base, -1)
    return at, ccc[cps[at]].astype(np.int64), base


def _ordered(cps: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Runs of marks in canonical order."""
    at, k, _ = _marks(cps, row, ccc)
    if not ((np.diff(at) == 1) & (k[:-1] > k[1:])).any():
        return cps
    new = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
    cps = cps.copy()
    cps[at] = cps[at][np.lexsort((k, np.cumsum(new)))]
    return cps


def _composed(cps: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined to their base, round by round, until nothing joins."""
    keys, to = pairs()
    while True:
        at, k, base = _marks(cps, row, ccc)
        # a mark joins if none between it and the base is of the same class or higher
        free = (base >= 0) & ((at - base == 1) | (np.concatenate([[0], k[:-1]]) < k))
        at, base = at[free], base[free]
        if not len(at):
            return cps, row
        key = cps[base].astype(np.int64) << 21 | cps[at]
        hit = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        good = keys[hit] == key
        at, base, hit = at[good], base[good], hit[good]
        if not len(at):
            return cps, row
        _, one = np.unique(base, return_index=True)
        cps = cps.copy()
        cps[base[one]] = to[hit[one]]
        cps, row = np.delete(cps, at[one]), np.delete(row, at[one])


def _syllables(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters joined to syllables: leading consonant and vowel, then a trailing consonant."""
    for first, last, begin, n in ((LEADING, LEADING + N_LEADING, VOWEL, N_VOWELS), (SYLLABLE, SYLLABLE + N_LEADING * N_VOWELS * N_TRAILING, TRAILING + 1, N_TRAILING - 1)):
        at = np.flatnonzero((cps[1:] >= begin) & (cps[1:] < begin + n) & (cps[:-1] >= first) & (cps[:-1] < last) & (row[1:] == row[:-1]))
        if begin != VOWEL:
            at = at[(cps[at] - SYLLABLE) % N_TRAILING == 0]
        if len(at):
            cps = cps.copy()
            cps[at] = SYLLABLE + ((cps[at] - LEADING) * N_VOWELS + cps[at + 1] - VOWEL) * N_TRAILING if begin == VOWEL else cps[at] + cps[at + 1] - TRAILING
            cps, row = np.delete(cps, at + 1), np.delete(row, at + 1)
    return cps, row


def _careful(column: pa.Array, words_only: bool, more: tuple[tuple[int, int], ...]) -> pa.Array:
    """Rows with marks, or with code points that become nothing or several: expanded, put in order, composed."""
    count, begin, flat, ccc = tables(words_only, more)
    cps, at = code_points(column)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    if len(cps):
        n = count[cps].astype(np.int64)
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        cps, row = flat[np.repeat(begin[cps], n) + step], np.repeat(row, n)
        cps, row = _syllables(*_composed(_ordered(cps, row, ccc), row, ccc))
    return to_arrow(cps, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int64), np.asarray(column.is_valid()))


def _parted(column: pa.Array, apart: np.ndarray, these, others) -> pa.Array:
    """these(the rows set apart) and others(the rest), in the old order."""
    if not apart.any() or apart.all():
        return (these if apart.any() else others)(column)
    both = pa.chunked_array([others(column.filter(pa.array(~apart))), these(column.filter(pa.array(apart)))]).combine_chunks()
    return both.take(pa.array(np.where(apart, (~apart).sum() + np.cumsum(apart) - 1, np.cumsum(~apart) - 1)))


def _changed(column: pa.Array, words_only: bool, more: tuple[tuple[int, int], ...]) -> pa.Array:
    """Rows whose code points each become one are gathered as they are; the others are set apart."""
    to, odd = direct(words_only, more)
    cps, at = code_points(column)
    care = odd[cps]
    if not care.any():
        return to_arrow(to[cps], at, np.asarray(column.is_valid()))
    sums = np.concatenate([[0], np.cumsum(care, dtype=np.int64)])[at]
    apart = np.diff(sums) > 0
    return _parted(column, apart, lambda c: _careful(c, words_only, more), lambda c: _changed(c, words_only, more))


def _ascii_words(column: pa.Array) -> pa.Array:
    """ASCII rows in lower case with blanks for what is no letter or digit, byte by byte."""
    to, _ = direct(True)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(to[:128].astype(np.uint8)[raw].tobytes()), mask)


def one_form(column: pa.Array, words_only: bool = False, more: tuple[tuple[int, int], ...] = ()) -> pa.Array:
    """The column in its one form; nulls stay null, empty texts empty. more: look-alikes beside LOOKS. Rows of ASCII characters are left as they are or, for words_only, mapped byte by byte."""
    column = column.cast(pa.large_string())
    plain = np.asarray(pc.fill_null(pc.string_is_ascii(column), True)) if len(column) else np.ones(0, bool)
    return _parted(column, ~plain, lambda c: _changed(c, words_only, more), _ascii_words if words_only else lambda c: c)


#: Characters of text handled at once; a batch of long texts is cut at rows.
MOST_CHARS = 4_000_000


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > MOST_CHARS:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < b.num_rows:
        yield b.slice(start)


def normalised(df: DataFrame, key: str, text: str, out: str = "norm_text", more: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """(key, text, out): every text in its one form.

    Made equal: full-width and half-width forms, ligatures and other compatibility forms that look like what they stand for, composed and combining accents,
    Hangul letters and their syllables, blanks of any width, hyphens, letters of other alphabets that look Latin (LOOKS, and more of them from confusables); what shows nothing is
    removed. Letter case, words, accents and line breaks stay. Null texts stay null, empty ones empty; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one_form(b.column(1), more=more).cast(pa.string())], names=[key, text, out])

    schema = T.StructType([df.schema[key], T.StructField(text, T.StringType()), T.StructField(out, T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)


def _prints(df: DataFrame, key: str, text: str, more: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, look, own): 128-bit prints of a text's one form and of its own characters; nulls are left out. Only prints leave the scan's stage."""
    n = normalised(df.filter(F.col(text).isNotNull()), key, text, more=more)
    return n.select(key, F.unhex(F.md5(F.col("norm_text"))).alias("look"), F.unhex(F.md5(F.col(text))).alias("own"))


def look_classes(df: DataFrame, key: str, text: str, more: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """(key, class_id, n_forms): one row per text that shares its look with different characters; class_id is the smallest key of the look, n_forms how many different texts share it."""
    p = settled(_prints(df, key, text, more))
    forms = p.groupBy("look", "own").agg(F.min(key).alias("least"))
    classes = settled(forms.groupBy("look").agg(F.count(F.lit(1)).alias("n_forms"), F.min("least").alias("class_id")).filter("n_forms > 1"))
    return spread_lookup(p, classes, "look").filter("n_forms is not null").select(key, "class_id", "n_forms")


def _salted(left: DataFrame, right: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """left with a salt from its column by, right once per salt."""
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")), right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def look_pairs(df: DataFrame, key: str, text: str, more: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """(a, b), a < b: all pairs of rows that look the same but are not the same characters.

    Copies of one text are no pair. Rows are first counted by look and form; looks of one form, however many rows have it, are dropped before anything is joined. Of the
    rest the forms of a look are paired, then the rows of both forms. Every join is salted, those of rows with forms by the row's key, so that neither a look of many forms nor a form of many rows is one task.
    """
    p = settled(_prints(df, key, text, more))
    forms = settled(p.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n")))
    shared = forms.join(forms.groupBy("look").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "look", "left_semi").select("look", "own")
    x, y = _salted(shared.withColumnRenamed("own", "own_a"), shared.withColumnRenamed("own", "own_b"), "own_a")
    pairs = settled(x.join(y, ["look", "salt"]).filter("own_a < own_b").select("own_a", "own_b"))
    rows, with_a = _salted(p.select(F.col(key).alias("key_a"), F.col("own").alias("own_a")), pairs, "key_a")
    rows_a = rows.join(with_a, ["own_a", "salt"]).select("key_a", "own_b")
    rows, with_b = _salted(p.select(F.col(key).alias("key_b"), F.col("own").alias("own_b")), pairs.select("own_b").distinct(), "key_b")
    rows_b = rows.join(with_b, ["own_b", "salt"], "left_semi").select("key_b", "own_b")
    rows_a, rows_b = _salted(rows_a, rows_b, "key_a")
    both = rows_a.join(rows_b, ["own_b", "salt"])
    return both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
