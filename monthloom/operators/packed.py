"""Several values packed in one field: splits learnt from the whole column.

A text is cut at every mark that might part values; quoted spans stay whole. Each stretch of such pieces is a candidate value, and the candidates form a lattice. A
candidate is scored by how many different values its first word begins, and by how often it is the value behind that word, mixed with how it is spelt: in how many values its other words
stand and how many words (or members) values have; a mark is scored by how often it parts. Expectation-maximisation over the whole column learns these frequencies, and a Viterbi pass takes the
most likely path. Lattices are worked on as arrays, all texts of a batch with the same number of pieces at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Marks that may part values outside quotes; a point never does.
MARKS = ";,&|/\n\t\r"
#: A word or value has a probability of its own if it counts at least as much as one in so many pieces; rarer ones are scored as new. That bounds the tables, whatever the column holds.
SHARE = 1 << 17
#: Words of a value that the table of lengths tells apart; longer ones share the last place.
MOST_WORDS = 64
#: Rounds of expectation-maximisation after the first count.
ROUNDS = 3
#: Pieces that one step over arrays holds.
CELLS = 1 << 20
#: The log probability of a candidate without any text.
HOLLOW = -1.0
#: A multiplier for the prints of stretches of pieces.
_STEP = 0x9E3779B97F4A7C15

_M = re.escape(MARKS)
_CUT = re.compile(f"[{_M}]")
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_DELIM = rf"(?=[\s{_M}.)\]]|\Z)"
_DOUBLE = rf'"(?:\\["\'\\]|""|[^"\\]|\\(?!["\'\\])|"(?!"){_DELIM.replace("(?=", "(?!", 1)})*+"(?!"){_DELIM}'
_SINGLE = rf"'(?:\\[\"'\\]|[^'\\]|\\(?![\"'\\])|'{_DELIM.replace('(?=', '(?!', 1)})*+'{_DELIM}"


def _token(double: bool, single: bool) -> re.Pattern:
    """One token of a text: a quoted span where one may begin, a bracket, a mark, plain text, or a quote that opens nothing."""
    quoted = "|".join([_DOUBLE] * double + [_SINGLE] * single) or "(?!)"
    return re.compile(rf"(?P<q>(?<![^\s{_M}(\[])(?:{quoted}))|(?P<b>[()\[\]])|(?P<m>[{_M}])|(?P<w>[^{_M}()\[\]\"']+|.)", re.S)


_TOKENS = {(d, s): _token(d, s) for d in (True, False) for s in (True, False)}
#: Where a quoted span may begin.
_OPENS = rf"(?:^|[\s{_M}(\[])[\"']"


def _plain(q: str) -> str:
    """The text inside a quoted span."""
    inner = q[1:-1]
    if q[0] == '"':
        inner = inner.replace('""', '"')
    return re.sub(r"\\([\"'\\])", r"\1", inner)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a text's tokens. A quote that finds no end is an ordinary character, and so are later ones of its kind."""
    double = single = True
    pattern, at, n = _TOKENS[True, True], 0, len(text)
    while at < n:
        m = pattern.match(text, at)
        kind, t = m.lastgroup, m.group()
        if kind == "w" and t in "\"'" and (at == 0 or text[at - 1].isspace() or text[at - 1] in MARKS + "(["):
            double, single = double and t != '"', single and t != "'"
            pattern = _TOKENS[double, single]
        yield kind, t
        at = m.end()


def pieces(text: str) -> tuple[list[str], list[str]]:
    """The pieces between the marks outside quotes, unquoted, and the mark before each ("" before the first). Pieces may be empty."""
    out, marks, buf = [], [""], []
    for kind, t in _tokens(text):
        if kind == "m":
            out.append("".join(buf))
            marks.append(t)
            buf = []
        else:
            buf.append(_plain(t) if kind == "q" else t)
    return [*out, "".join(buf)], marks


_ROUND = str.maketrans("[]", "()")


def members(text: str) -> tuple[list[str], list[str]]:
    """The members between marks and brackets outside quotes, trimmed and unquoted, and what stands before each: marks and round brackets without blanks.

    A bracket parts where a member might begin, and its partner where that one ends; other brackets are ordinary characters. Nothing between two marks, or between a mark and the bracket that ends a
    group, is an empty member; so are None and null.
    """
    out, before, buf, sep = [], [], [], ""
    began, wants, opened = False, True, []  # a member has begun; one must come; open brackets and whether they part

    def end() -> None:
        nonlocal buf, sep, began
        m = "".join(buf).strip()
        out.append("" if m in ("None", "null") and buf[0] is not None else m)
        before.append(sep)
        buf, sep, began = [], "", False

    for kind, t in _tokens(text):
        if kind == "m":
            if began or wants:
                end()
            sep, wants = sep + t, True
        elif kind == "b" and t in "([":
            opened.append(not began)
            if began:
                buf.append(t)
            else:
                sep, wants = (sep if sep.endswith("(") else sep + "("), True
        elif kind == "b":
            if opened and not opened.pop():
                buf.append(t)
                continue
            if began or wants:
                end()
            sep, wants = (sep if sep.endswith(")") else sep + ")"), False
        elif kind == "q":
            buf.append(_plain(t))
            began, wants = True, False
        elif began or not t.isspace():
            buf.append(t)
            began, wants = True, False
    if began or (wants and sep.translate(_ROUND)[-1:] not in ("", "(")):
        end()
    if before:
        before[0] = ""
    return out, before


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def value_print(parts: list[str]) -> int:
    """The print of a value of these pieces, as a signed number."""
    h = 0
    for p in parts:
        h = (h * _STEP + _print(p)) & (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Model:
    """Learnt log probabilities of one column. arity: the members of every value, or None for values of any number of pieces."""

    arity: int | None = None
    heads: dict[str, float] = field(default_factory=dict)
    inner: dict[str, float] = field(default_factory=dict)
    new_head: float = 0.0
    new_inner: float = 0.0
    #: How many values, of all, begin with a word, as occurrences.
    begun: dict[str, float] = field(default_factory=dict)
    #: By the number of words of a value (or, with an arity, of its members).
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(MOST_WORDS))
    #: (parts, doesn't part) of each mark.
    marks: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: By number of pieces: the sorted prints of whole values and their log probabilities.
    values: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def mark(self, m: str) -> tuple[float, float]:
        return self.marks.get(m, (math.log(0.8), math.log(0.2)))

    def whole(self, prints: np.ndarray, k: int) -> np.ndarray:
        """The log probability of values of k pieces as such; -inf for those not seen."""
        if k not in self.values:
            return np.full(prints.shape, -np.inf)
        keys, logs = self.values[k]
        at = np.minimum(np.searchsorted(keys, prints), len(keys) - 1)
        return np.where(keys[at] == prints, logs[at], -np.inf)


class Batch:
    """The pieces of many texts with the scores a model gives them."""

    def __init__(self, model: Model, sizes: np.ndarray, parts: pa.Array, marks: pa.Array) -> None:
        self.model, self.sizes = model, sizes
        self.begin = np.cumsum(sizes) - sizes
        coded = parts.dictionary_encode()
        self.texts: list[str] = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        words = [_WORD.findall(t) for t in self.texts]
        inner = [[model.inner.get(w, model.new_inner) for w in ws] for ws in words]
        self.n_words = np.array([len(ws) for ws in words], np.int64)
        self.inner = np.array([sum(x) for x in inner])
        self.rest = np.array([sum(x[1:]) for x in inner])
        self.firsts = [ws[0] if ws else "" for ws in words]
        self.head = np.array([model.heads.get(w, model.new_head) for w in self.firsts])
        self.begun = np.array([model.begun.get(w, -math.log(SHARE)) for w in self.firsts])
        self.prints = np.array([_print(t) for t in self.texts], np.uint64)
        self.alone = model.whole(self.prints.view(np.int64), 1)
        marked = marks.dictionary_encode()
        self.mark_texts: list[str] = marked.dictionary.to_pylist()
        self.mark_code = marked.indices.to_numpy(zero_copy_only=False)
        odds = np.array([model.mark(m) for m in self.mark_texts]).reshape(-1, 2)
        self.out_of, self.in_of = odds[:, 0], odds[:, 1]

    def groups(self) -> Iterator[np.ndarray]:
        """Places of pieces, (texts, n): texts of the same number of pieces, so many that a step over all their stretches' ends stays bounded."""
        for n in np.unique(self.sizes[self.sizes > 0]).tolist():
            rows = np.flatnonzero(self.sizes == n)
            step = max(1, CELLS // n)
            for i in range(0, len(rows), step):
                yield self.begin[rows[i : i + step]][:, None] + np.arange(n)


class Lattice:
    """The candidate values of texts with n pieces each."""

    def __init__(self, batch: Batch, at: np.ndarray) -> None:
        self.batch, self.at, self.model = batch, at, batch.model
        code, mark = batch.code[at], batch.mark_code[at]
        self.t, self.n = at.shape
        self.code = code
        self.head, self.rest, self.begun = batch.head[code], batch.rest[code], batch.begun[code]
        self.alone = batch.alone[code]
        self.out_of = batch.out_of[mark]
        self.out_of[:, 0] = 0.0
        self.stay, self.kept = np.cumsum(batch.inner[code], axis=1), np.cumsum(batch.in_of[mark], axis=1)
        self.words = np.cumsum(batch.n_words[code], axis=1)
        self.before = self.words - batch.n_words[code]
        prints = batch.prints[code]
        self.prints = np.zeros((self.t, self.n + 1), np.uint64)
        for j in range(self.n):
            self.prints[:, j + 1] = self.prints[:, j] * np.uint64(_STEP) + prints[:, j]

    def stretch_prints(self, j: int) -> np.ndarray:
        """The prints of the stretches i..j for all i."""
        power = np.cumprod(np.full(j + 1, _STEP, np.uint64))[::-1]
        return (self.prints[:, j + 1 : j + 2] - self.prints[:, : j + 1] * power).view(np.int64)

    def ends(self, j: int) -> np.ndarray:
        """(texts, j + 1): the log probability of the stretch i..j as a value, with the mark before it."""
        m = self.model
        n_words = self.words[:, j : j + 1] - self.before[:, : j + 1]
        size = np.arange(j + 1, 0, -1)
        marks = self.kept[:, j : j + 1] - self.kept[:, : j + 1]
        spelt = self.rest[:, : j + 1] + self.stay[:, j : j + 1] - self.stay[:, : j + 1]
        if not m.arity:
            spelt = spelt + m.lengths[np.minimum(n_words, MOST_WORDS - 1)]
        whole = np.full(spelt.shape, -np.inf)
        whole[:, j] = self.alone[:, j]
        if ks := [k for k in m.values if 1 < k <= j + 1]:
            prints = self.stretch_prints(j)
            for k in ks:
                whole[:, j + 1 - k] = m.whole(prints[:, j + 1 - k], k)
        score = self.head[:, : j + 1] + np.logaddexp(spelt, whole - self.begun[:, : j + 1]) + math.log(0.5) + marks
        if m.arity:
            score = score + m.lengths[np.minimum(size, MOST_WORDS - 1)]
        return np.where(n_words == 0, HOLLOW, score) + self.out_of[:, : j + 1]

    def best(self) -> np.ndarray:
        """(texts, n): whether a value begins at each piece, on the most likely path."""
        top, back = np.zeros((self.t, self.n + 1)), np.zeros((self.t, self.n + 1), np.int64)
        rows = np.arange(self.t)
        for j in range(self.n):
            s = top[:, : j + 1] + self.ends(j)
            # of equally likely paths the one with the later beginning
            back[:, j + 1] = j - np.argmax(s[:, ::-1], axis=1)
            top[:, j + 1] = s[rows, back[:, j + 1]]
        begins, j = np.zeros((self.t, self.n), bool), np.full(self.t, self.n)
        while (on := j > 0).any():
            j = np.where(on, back[rows, j], 0)
            begins[rows[on], j[on]] = True
        return begins

    def expected(self) -> Iterator[tuple[int, np.ndarray]]:
        """(j, posteriors of the stretches i..j as values) over all paths."""
        a = np.zeros((self.t, self.n + 1))
        for j in range(self.n):
            a[:, j + 1] = np.logaddexp.reduce(a[:, : j + 1] + self.ends(j), axis=1)
        b = np.full((self.t, self.n + 1), -np.inf)
        b[:, self.n] = 0.0
        for j in range(self.n - 1, -1, -1):
            s = self.ends(j) + b[:, j + 1 : j + 2]
            b[:, : j + 1] = np.logaddexp(b[:, : j + 1], s)
            yield j, np.exp(np.minimum(a[:, : j + 1] + s - a[:, self.n :], 0.0))


_COUNTS = "kind string, text string, print long, size int, words int, n double, s double, v double"


def _counted(batch: Batch, first: bool) -> pa.RecordBatch:
    """The expected counts of a batch: for each piece how often it stands, begins a value and is one; for each mark how often it stands and parts; for each longer stretch how often it is a value."""
    arity = batch.model.arity
    begins, alone, used = (np.zeros(len(batch.code)) for _ in range(3))
    prints, sizes, words, firsts, shares = [], [], [], [], []
    length = np.zeros(MOST_WORDS)
    for at in batch.groups():
        lat = Lattice(batch, at)
        if first and arity and lat.n % arity:
            continue  # where the count doesn't tell the values, the first round will
        used[at] = 1.0
        if first:
            step = arity or 1
            found = ((j, np.broadcast_to(np.arange(j + 1) == j + 1 - step, (lat.t, j + 1)).astype(float)) for j in range(step - 1, lat.n, step))
        else:
            found = lat.expected()
        for j, p in found:
            begins[at[:, : j + 1]] += p
            alone[at[:, j]] += p[:, j]
            np.add.at(length, np.minimum(np.arange(j + 1, 0, -1), MOST_WORDS - 1), p.sum(axis=0))
            if j:
                x, i = np.nonzero(p[:, :j] > 1e-3)
                prints.append(lat.stretch_prints(j)[x, i])
                sizes.append(j + 1 - i)
                words.append(lat.words[x, j] - lat.before[x, i])
                firsts.append(lat.code[x, i])
                shares.append(p[x, i])
    count = lambda code, w, n: np.bincount(code, weights=w, minlength=n)
    k, m = len(batch.texts), len(batch.mark_texts)
    n, s, v = (count(batch.code, w, k) for w in (used, begins, alone))
    inside = used.copy()
    inside[batch.begin[batch.sizes > 0]] = 0.0
    mn, ms = count(batch.mark_code, inside, m), count(batch.mark_code, inside * begins, m)
    no = lambda n: np.zeros(n, np.int64)
    rows = [("p", batch.texts, batch.prints.view(np.int64), no(k) + 1, batch.n_words, n, s, v), ("m", batch.mark_texts, no(m), no(m), no(m), mn, ms, no(m)), ("k", [""] * MOST_WORDS, no(MOST_WORDS), np.arange(MOST_WORDS), no(MOST_WORDS), length, length, length)]
    if prints:
        one, back = np.unique(np.stack([np.concatenate(prints), np.concatenate(sizes), np.concatenate(words), np.concatenate(firsts)]), axis=1, return_inverse=True)
        total = np.bincount(back.ravel(), weights=np.concatenate(shares), minlength=one.shape[1])
        rows.append(("v", [batch.firsts[c] for c in one[3].tolist()], one[0], one[1], one[2], total, total, total))
    kinds = pa.array([r[0] for r in rows for _ in range(len(r[1]))], pa.string())
    texts = pa.array([t for r in rows for t in r[1]], pa.string())
    whole = [pa.array(np.concatenate([r[c] for r in rows])) for c in (2, 3, 4)]
    parts = [pa.array(np.concatenate([r[c] for r in rows]).astype(float)) for c in (5, 6, 7)]
    out = pa.RecordBatch.from_arrays([kinds, texts, whole[0], whole[1].cast(pa.int32()), whole[2].cast(pa.int32()), *parts], names=["kind", "text", "print", "size", "words", "n", "s", "v"])
    return out.filter(pc.greater(out.column("n"), 0.0))


def _tables(counts: DataFrame) -> DataFrame:
    """(name, key, x): the sums the model is made of. heads and inner count different pieces, each by the share of its occurrences that begin a value (or don't), not occurrences: what often stands behind one value is no head for that."""
    g = counts.groupBy("kind", "text", "print", "size", "words").agg(*[F.sum(c).alias(c) for c in ("n", "s", "v")])
    row = lambda name, key, x: F.struct(F.lit(name).alias("name"), key.cast("string").alias("key"), x.cast("double").alias("x"))
    ws = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    head, begins = F.try_element_at(ws, F.lit(1)), F.least(F.col("s") / F.col("n"), F.lit(1.0))
    piece = F.concat(
        F.array(row("head", head, begins), row("inner", head, 1 - begins), row("length", F.col("words"), F.least(F.col("v") / F.col("n"), F.lit(1.0))), row("value", F.concat_ws(" ", "size", "print"), F.col("v")), row("begun", head, F.col("v"))),
        F.transform(F.array_distinct(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))), lambda w: row("inner", w, F.lit(1.0))),
    )
    stretch = F.array(row("length", F.col("words"), F.least(F.col("v"), F.lit(1.0))), row("value", F.concat_ws(" ", "size", "print"), F.col("v")), row("begun", F.col("text"), F.col("v")))
    mark = F.array(row("parts", F.col("text"), F.col("s")), row("stands", F.col("text"), F.col("n")))
    cells = F.when(F.col("kind") == "p", piece).when(F.col("kind") == "v", stretch).when(F.col("kind") == "m", mark).otherwise(F.array(row("members", F.col("size"), F.col("v"))))
    return g.select(F.explode(cells).alias("c")).select("c.*").filter("key is not null and x > 0").groupBy("name", "key").agg(F.sum("x").alias("x"))


def _learnt_model(tables: DataFrame, least: float, arity: int | None, whole: bool) -> Model:
    """The model of the sums. Those below least aren't collected: as it is a SHARE-th of the pieces, no more than SHARE rows of a table a word of a piece come; the totals, in the same job, are over all."""
    sums = tables.groupBy("name").agg(F.sum("x").alias("x"), F.sum(F.least(F.col("x"), F.lit(1.0))).alias("n"))
    rows = tables.filter(F.col("x") >= least).select("name", "key", "x", F.lit(None).cast("double").alias("n")).unionByName(sums.select("name", F.lit(None).cast("string").alias("key"), "x", "n"))
    total, different = {}, {}
    got: dict[str, dict[str, float]] = {k: {} for k in ("head", "inner", "begun", "length", "value", "parts", "stands", "members")}
    for r in rows.collect():
        if r["key"] is None:
            total[r["name"]], different[r["name"]] = r["x"], r["n"]
        else:
            got[r["name"]][r["key"]] = r["x"]
    m = Model(arity)
    # a word's first piece says nothing: that share goes to new words, many where many different words are seen and few where few are
    n_words = different.get("head", 0.0) + different.get("inner", 0.0)
    for name, into in (("head", m.heads), ("inner", m.inner)):
        new, all_of = (different.get(name, 0.0) + 0.5) / (n_words + 1), total.get(name, 0.0) + 1
        into |= {w: math.log((max(x - 1, 0) + new) / all_of) for w, x in got[name].items()}
        setattr(m, f"new_{name}", math.log(new / all_of))
    lengths = 0.3 * 0.7 ** np.arange(MOST_WORDS) * (1 + 0.02 * total.get("length", 0.0))  # some of every length, fewer of longer ones
    for k, x in (got["members"] if arity else got["length"]).items():
        lengths[min(int(k), MOST_WORDS - 1)] += x
    if arity:
        lengths[arity] += 0.05 * lengths.sum() + 20.0
    m.lengths = np.log(lengths / lengths.sum())
    m.begun = {w: math.log(x / total["value"]) for w, x in got["begun"].items()}
    for mark, n in got["stands"].items() if whole or arity else []:  # the first count only assumed that every mark parts
        parts = got["parts"].get(mark, 0.0)
        m.marks[mark] = (math.log((parts + 4.0) / (n + 5.0)), math.log((n - min(parts, n) + 1.0) / (n + 5.0)))
    if whole:
        by_size: dict[int, list[tuple[int, float]]] = {}
        for key, x in got["value"].items():
            k, h = map(int, key.split(" "))
            if x > 1.001:  # what is expected to occur once says nothing
                by_size.setdefault(k, []).append((h, math.log((x - 1) / total["value"])))
        for k, rows in by_size.items():
            rows.sort()
            m.values[k] = (np.array([h for h, _ in rows], np.int64), np.array([x for _, x in rows]))
    return m


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(pieces of each text, all pieces trimmed, the marks before them)."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("parts")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, pc.utf8_trim_whitespace(batch.column("parts").flatten()), batch.column("marks").flatten()


def cut(df: DataFrame, key: str, column: str, arity: int | None = None) -> DataFrame:
    """(key, parts, marks): the texts of a column cut at every mark, and what stands before each piece. Empty pieces are left out where a value may be of any size. Null texts and texts without pieces are left out."""

    def built(keys: pa.Array, sizes: np.ndarray, parts: pa.Array, marks: pa.Array) -> pa.RecordBatch:
        if not arity:
            keep = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(parts), ""))
            sums = np.concatenate([[0], np.cumsum(keep)])
            ends = np.cumsum(sizes)
            sizes = sums[ends] - sums[ends - sizes]
            parts, marks = parts.filter(pa.array(keep)), marks.filter(pa.array(keep))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        out = pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, parts), pa.ListArray.from_arrays(offsets, marks)], names=[key, "parts", "marks"])
        return out.filter(pa.array(sizes > 0))

    single = pa.array(["", *MARKS])
    code = np.zeros(128, np.int64)
    code[[ord(c) for c in MARKS]] = np.arange(1, len(MARKS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 5_000):
                b = whole.slice(start, 5_000)
                text = b.column(1)
                slow = np.ones(b.num_rows, bool) if arity else np.asarray(pc.match_substring_regex(text, _OPENS))
                if not slow.all():  # texts without quotes are cut as one array
                    keys, plain = b.column(0).filter(pa.array(~slow)), text.filter(pa.array(~slow))
                    lists = pc.split_pattern_regex(plain, f"[{_M}]")
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                    between = pc.replace_substring_regex(plain, f"[^{_M}]+", "")
                    marks = np.zeros(sizes.sum(), np.int64)
                    inside = np.ones(len(marks), bool)
                    inside[np.cumsum(sizes) - sizes] = False
                    marks[inside] = code[np.frombuffer("".join(between.to_pylist()).encode(), np.uint8)]
                    yield built(keys, sizes, lists.flatten(), single.take(pa.array(marks)))
                if slow.any():
                    found = [(members if arity else pieces)(t) for t in text.filter(pa.array(slow)).to_pylist()]
                    sizes = np.array([len(p) for p, _ in found], np.int64)
                    parts = pa.array([x for p, _ in found for x in p], pa.string())
                    yield built(b.column(0).filter(pa.array(slow)), sizes, parts, pa.array([x for _, m in found for x in m], pa.string()))

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("marks", T.ArrayType(T.StringType()))])
    return df.filter(F.col(column).isNotNull()).select(key, F.col(column).cast("string").alias("_text")).mapInArrow(run, schema)


def learnt(texts: DataFrame, arity: int | None = None, rounds: int = ROUNDS) -> Model:
    """The model of the texts that cut has cut. The first count takes every mark as one that parts (or every arity-th, in texts whose count fits); whole values count from the second round on, since the first only assumed them."""
    least = (texts.agg(F.sum(F.size("parts"))).first()[0] or 0) / SHARE
    model = _learnt_model(_tables(_pass(texts, Model(arity), True)), least, arity, False)
    for _ in range(rounds):
        model = _learnt_model(_tables(_pass(texts, model, False)), least, arity, True)
    return model


def _pass(texts: DataFrame, model: Model, first: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _counted(Batch(sent.value, *_flat(b)), first)

    return texts.select("parts", "marks").mapInArrow(run, _COUNTS)


def split_values(df: DataFrame, key: str, column: str, arity: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, pos, item, n_values): one row per value of the column, pos from 1.

    arity None: values are texts of any number of pieces; marks inside one are kept. Else a value has that many members, given as the non-empty ones joined by one blank; values and
    members may be parted by marks, brackets or both. Null and empty texts give no rows; empty values are skipped and not counted; repeated rows give repeated values; a quote that isn't closed
    is an ordinary character; a value may have any number of pieces, so that the time for a text grows with the square of its pieces; extra columns are ignored.
    """
    texts = settled(cut(df, key, column, arity))  # every round reads it
    model = df.sparkSession.sparkContext.broadcast(learnt(texts, arity, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, parts, marks = _flat(b)
            batch = Batch(model.value, sizes, parts, marks)
            begins = np.zeros(len(parts), bool)
            for at in batch.groups():
                begins[at] = Lattice(batch, at).best()
            at = np.flatnonzero(begins)
            ends = np.append(at[1:], len(parts))[: len(at)]
            if arity:
                said = np.asarray(pc.not_equal(parts, ""))
                sums = np.concatenate([[0], np.cumsum(said)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(sums[at], sums[-1]), pa.int32()), parts.filter(pa.array(said)))
                items = pc.binary_join(lists, " ")
            else:
                items = parts.take(pa.array(at))
                if (long := np.flatnonzero(ends - at > 1)).size:
                    raw, texts_ = b.column("parts").flatten(), items.to_pylist()
                    for k in long.tolist():
                        span = range(at[k], ends[k])
                        texts_[k] = "".join(("" if i == at[k] else marks[i].as_py()) + raw[i].as_py() for i in span).strip()
                    items = pa.array(texts_, pa.string())
            row = np.repeat(np.arange(b.num_rows), sizes)[at]
            there = np.asarray(pc.not_equal(items, ""))
            row, items = row[there], items.filter(pa.array(there))
            n = np.bincount(row, minlength=b.num_rows)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(pos, pa.int32()), items.cast(pa.string()), pa.array(n[row], pa.int32())], names=[key, "pos", "item", "n_values"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("n_values", T.IntegerType())])
    return texts.select(key, "parts", "marks").mapInArrow(run, schema)
