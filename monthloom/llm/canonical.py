"""Freely typed values mapped to a reference list by trees over a true edit metric.

Burkhard-Keller trees hold the forms of the reference entries (names, their consonants and beginnings, cities, codes); the triangle inequality prunes their branches, so that a query
returns every form within its threshold without visiting most of the others. Each different typed form is searched once, many at a time: the distances of a node to all queries that reach it are
computed together. Up to SHARD forms are one broadcast tree; longer lists are cut into shards that meet the queries in co-grouped tasks. Every form that any shard finds comes back, and the typed
fields are decided once, over all of them, so that the answer doesn't depend on the shards.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, small, spread_lookup

#: Forms of one tree; what is broadcast never holds more.
SHARD = 50_000
#: Queries that meet a shard in one task.
QUERIES = 100_000
#: Answers that a worker remembers.
REMEMBERED = 200_000
#: So few queries at a node are compared one by one.
FEW = 24
#: How much better than the second the best entry must be.
CLEAR = 0.25

# The kinds of airfield, each with the ways to write it; then words that only say "airport".
KINDS = {
    "international": "international internatl intl intnl inter",
    "municipal": "municipal muni mun municpl",
    "regional": "regional rgnl reg regl",
    "county": "county cnty co cty",
    "memorial": "memorial meml mem",
    "executive": "executive exec",
    "airpark": "airpark airpk",
    "field": "field fld fd",
}
PLAIN = "airport arpt apt ap aprt airpt"
# Words before a name that don't belong to it; beginnings of names and how they are shortened; texts that mean no value.
LEADING = {"at", "the", "near", "off", "of", "nr", "by", "over", "vicinity", "from", "to"}
BEGINNINGS = {"mt": "mount", "ft": "fort", "st": "saint", "pt": "port", "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west"}
NO_VALUE = {"", "na", "none", "null", "nan", "unknown", "unk", "notreported", "notavailable", "tbd", "nil", "notgiven"}


class FromForm:
    """Levenshtein's distances from one form, bit-parallel; what depends on the form alone is computed once."""

    __slots__ = ("form", "masks", "full", "top")

    def __init__(self, form: str) -> None:
        self.form, self.masks = form, {}
        for i, c in enumerate(form):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << len(form)) - 1, 1 << len(form) >> 1

    def to(self, other: str) -> int:
        if other == self.form:
            return 0
        if not other or not self.form:
            return len(other) or len(self.form)
        get, full, top = self.masks.get, self.full, self.top
        up, down, score = full, 0, len(self.form)
        for c in other:
            m = get(c, 0)
            d = (((m & up) + up) ^ up) | m | down
            h, g = down | (~(d | up) & full), up & d
            if h & top:
                score += 1
            elif g & top:
                score -= 1
            h, g = (h << 1 | 1) & full, (g << 1) & full
            up, down = (g | (~(d | h) & full)), h & d
        return score


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance."""
    return FromForm(a).to(b)


class BKTree:
    """Forms with what they stand for, by their distances to each other."""

    def __init__(self) -> None:
        self.root: list | None = None  # [form, payloads, {distance: node}]

    def add(self, form: str, payload: int) -> None:
        if self.root is None:
            self.root = [form, [payload], {}]
            return
        node = self.root
        while True:
            d = edit_distance(form, node[0])
            if d == 0:
                node[1].append(payload)
                return
            if d not in node[2]:
                node[2][d] = [form, [payload], {}]
                return
            node = node[2][d]

    def within(self, form: str, most: int) -> list[tuple[int, str, list[int]]]:
        """Every (distance, form, payloads) at most so far."""
        return [(d, f, p) for _, d, f, p in self.within_many([form], [most])]

    def within_many(self, forms: list[str], most: list[int]) -> list[tuple[int, int, str, list[int]]]:
        """Every (query, distance, form, payloads) with the distance at most that of the query."""
        if self.root is None or not forms:
            return []
        far = np.array(most, np.int64)
        size = np.array([len(f) for f in forms], np.int64)
        order = np.argsort(size, kind="stable")
        letters: dict[str, int] = {}
        text = np.full((int(size.max()), len(forms)), 0, np.int32) if size.max() <= 64 else None
        if text is not None:
            for q, f in enumerate(forms):
                for i, c in enumerate(f):
                    text[i, q] = letters.setdefault(c, len(letters))
        out, todo = [], [(self.root, order)]
        while todo:
            node, sel = todo.pop()
            if not node[2]:  # a leaf that its length rules out
                sel = sel[np.abs(size[sel] - len(node[0])) <= far[sel]]
                if not len(sel):
                    continue
            if len(sel) <= FEW or text is None or not 0 < len(node[0]) <= 64:
                to = FromForm(node[0]).to
                d = np.array([to(forms[q]) for q in sel.tolist()], np.int64)
            else:
                d = _distances(node[0], letters, text, size, sel)
            near = d <= far[sel]
            out += [(q, x, node[0], node[1]) for q, x in zip(sel[near].tolist(), d[near].tolist())]
            for k, child in node[2].items():
                on = sel[np.abs(d - k) <= far[sel]]
                if len(on):
                    todo.append((child, on))
        return out


def _distances(form: str, letters: dict[str, int], text: np.ndarray, size: np.ndarray, sel: np.ndarray) -> np.ndarray:
    """Levenshtein's distances of a form of up to 64 characters to the queries sel, ordered by length: the bit-parallel columns of all of them at once."""
    masks = np.zeros(len(letters) + 1, np.uint64)
    for i, c in enumerate(form):
        if c in letters:
            masks[letters[c]] |= np.uint64(1 << i)
    one, top = np.uint64(1), np.uint64(1 << len(form) - 1)
    n = size[sel]
    up, down = np.full(len(sel), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(sel), np.uint64)
    score = np.full(len(sel), len(form), np.int64)
    for i in range(int(n[-1])):
        s = int(np.searchsorted(n, i, side="right"))  # the shorter ones are done
        m, u, w = masks[text[i, sel[s:]]], up[s:], down[s:]
        d = (((m & u) + u) ^ u) | m | w
        h, g = w | ~(d | u), u & d
        score[s:] += ((h & top) != 0).astype(np.int64) - ((g & top) != 0)
        h, g = h << one | one, g << one
        up[s:], down[s:] = g | ~(d | h), h & d
    return score


def reach(n: int) -> int:
    """The distance within which a form of n characters may still be meant."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 8 else 3 if n < 12 else 4


def _ascii(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _words(text: str) -> list[str]:
    """The words of a name: apostrophes and points dropped, other marks parting, letters typed apart joined."""
    ws = re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"['.`’]", "", _ascii(text))).split()
    out: list[str] = []
    i = 0
    while i < len(ws):
        j = i
        while j < len(ws) and len(ws[j]) == 1 and ws[j].isalpha():
            j += 1
        if j - i >= 3:
            out.append("".join(ws[i:j]))
            i = j
        else:
            out.append(ws[i])
            i += 1
    return out


def _skeleton(word: str) -> str:
    return re.sub(r"[aeiou]", "", word)


def _abbreviations() -> tuple[dict[str, str], dict[str, str]]:
    full = {w: kind for kind, ws in KINDS.items() for w in ws.split()} | dict.fromkeys(PLAIN.split(), "")
    return full, {_skeleton(w): k for w, k in full.items() if _skeleton(w)}


_KIND, _KIND_BARE = _abbreviations()
_LONG_KINDS = [w for w in _KIND if len(w) >= 7 or w in ("county", "field")]
_WHOLE_KINDS = [*KINDS, "airport", "air"]
KIND_OF = {k: k for k in KINDS} | {"airport": None, "air": "airpark"}
_SUFFIXES = sorted((w for w in _KIND if len(w) >= 2), key=len, reverse=True)


@lru_cache(REMEMBERED)
def _kind(word: str, bare: bool, loose: bool = True) -> str | None:
    """The kind a word means, "" for a word that only says airport, None for other words."""
    if word in _KIND:
        return _KIND[word]
    if bare and word in _KIND_BARE:
        return _KIND_BARE[word]
    if loose and len(word) >= 5:
        for w in _LONG_KINDS:
            if abs(len(w) - len(word)) <= 3 and edit_distance(word, w) <= (1 if len(w) < 7 else 2 if len(w) < 9 else 3):
                return _KIND[w]
    return None


class Name:
    """What a typed airport name says: core, kind (None if not said), the rest after a comma or the word airport."""

    __slots__ = ("core", "kind", "rest", "said", "bare")

    def __init__(self, core: str, kind: str | None, rest: list[str], said: bool, bare: bool) -> None:
        self.core, self.kind, self.rest, self.said, self.bare = core, kind, rest, said, bare


@lru_cache(REMEMBERED)
def read_name(text: str | None) -> list[Name]:
    """The readings of a typed name, the plainest first; none for no value."""
    if text is None or "".join(_words(text)) in NO_VALUE:
        return []
    head, _, tail = text.partition(",")
    words, rest = _words(head), _words(tail)
    if rest and len(words) == 1 and words[0] in BEGINNINGS:
        words, rest = words + rest, []
    if rest and ((only := _readings(rest, [])[0]).said and not only.core or any(_kind(w, False, False) for w in rest[:2])):
        words, rest = words + rest, []  # the mark stood before the kind
    while words and (words[0] in LEADING or words[0] in ("rwy", "runway")) and len(words) > 1:
        words = words[2:] if words[0] in ("rwy", "runway") and len(words) > 2 and words[1][:2].isdigit() else words[1:]
    out = _readings(words, rest)
    if len(words) > 1 and words[-1] not in _KIND and any(k.startswith(words[-1]) for k in _WHOLE_KINDS):  # cut off within the kind
        cut = {KIND_OF[k] for k in _WHOLE_KINDS if k.startswith(words[-1])}
        out += [Name(r.core, next(iter(cut)) if len(cut) == 1 else None, rest, True, r.bare) for r in _readings(words[:-1], rest)[:1]]
    if len(words) > 2:  # the first word typed last, or the last first
        out += [r for turned in ([words[-1], *words[:-1]], [*words[1:], words[0]]) for r in _readings(turned, rest) if r.core]
    return out if any(r.core for r in out) else []


def _readings(words: list[str], rest: list[str]) -> list[Name]:
    bare = not re.search(r"[aeiou]", "".join(words)) and len("".join(words)) >= 3
    words = [BEGINNINGS.get(w, w) if i == 0 and len(words) > 1 else w for i, w in enumerate(words)]
    core, kind, said = [], None, False
    i = 0
    while i < len(words):
        w = words[i]
        two = w + words[i + 1] if i + 1 < len(words) else ""
        if two in ("airpark", "airpk", "airprk", "aripark", "arpark") or (bare and two in ("rprk", "rpk")) or (w in ("air", "ar", "ir") and two and edit_distance(two, "airpark") <= 2):
            kind, said, i = "airpark", True, i + 2
            continue
        k = None if bare and i == 0 and len(words) > 2 and w not in _KIND else _kind(w, bare)  # "prt" may be port
        if k is not None:
            said = True
            kind = k or kind
            if k == "" and core and i + 1 < len(words) and _kind(words[i + 1], bare) is None:
                rest = words[i + 1 :] + rest
                break
        else:
            core.append(w)
        i += 1
    out = [Name("".join(core), kind, rest, said, bare)]
    whole = "".join(words)
    if len(words) <= 2 and len(whole) > 6:  # typed without blanks
        left, kinds = whole, []
        while s := next((s for s in _SUFFIXES if left.endswith(s) and len(left) - len(s) >= 3), None):
            kinds.append(_KIND[s])
            left = left[: -len(s)]
            out.append(Name(left, next((k for k in kinds if k), None), rest, True, bare))
    return out


def place_form(words: list[str]) -> str:
    """A place as one word; "" for no value."""
    words = [BEGINNINGS.get(w, w) if i == 0 and len(words) > 1 else w for i, w in enumerate(words)]
    joined = "".join(words)
    return "" if joined in NO_VALUE else joined


def entry_forms(reference: DataFrame, codes: list[str]) -> DataFrame:
    """(id, core, bones, kind, city, state, states, codes): what an entry of the list is searched by. states: the ways to write its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                readings = read_name(r["name"])
                core, kind = (readings[0].core, readings[0].kind) if readings else ("", None)
                state = (r["state"] or "").lower()
                ways = {state, "".join(_words(r["full_state"])) if r.get("full_state") else ""} - {""}
                rows.append((core, _skeleton(core), kind, place_form(_words(r["city"] or "")), state, sorted(ways), sorted({c.lower() for k in codes if (c := r.get(k))})))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string()] * 5 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=["id", "core", "bones", "kind", "city", "state", "states", "codes"])

    wanted = [c for c in ("name", "city", "state", "full_state", *codes) if c in reference.columns]
    schema = f"id {reference.schema['id'].dataType.simpleString()}, core string, bones string, kind string, city string, state string, states array<string>, codes array<string>"
    return reference.filter("id is not null").select("id", *[F.col(c).cast("string").alias(c) for c in wanted]).mapInArrow(run, schema)


def _forms(entries: DataFrame) -> DataFrame:
    """(role, form, target): the forms of the trees and the names, cities and codes that they stand for. Roles: name, bones, head (a name cut off), city, cityhead, code."""
    row = lambda role, form, target: F.struct(F.lit(role).alias("role"), form.alias("form"), F.col(target).alias("target"))
    heads = lambda role, c: F.when(F.length(c) > 4, F.transform(F.sequence(F.lit(4), F.greatest(F.length(c) - 1, F.lit(4))), lambda n: row(role, F.substring(F.col(c), F.lit(1), n), c))).otherwise(F.array().cast("array<struct<role:string,form:string,target:string>>"))
    every = F.concat(F.array(row("name", F.col("core"), "core"), row("bones", F.col("bones"), "core"), row("city", F.col("city"), "city")), heads("head", "core"), heads("cityhead", "city"), F.transform("codes", lambda c: F.struct(F.lit("code").alias("role"), c.alias("form"), c.alias("target"))))
    return entries.select(F.explode(every).alias("f")).select("f.*").filter("form != '' and target != ''").distinct()


_READING = "array<struct<core:string,kind:string,bare:boolean,said:boolean>>"
_PLACE = "struct<whole:string,key1:string,form1:string,key2:string,form2:string>"


def _read(triples: DataFrame) -> DataFrame:
    """Typed triples with what their fields may say: plain readings of the name, those of the city if it may hold the name instead, and the places, each with and without a state behind it."""

    def place(words: list[str]) -> dict:
        p = {"whole": place_form(words), "key1": None, "form1": None, "key2": None, "form2": None}
        for n in (1, 2):
            if len(words) > n:
                left = words[:-n]
                left = [BEGINNINGS.get(w, w) if i == 0 and len(left) > 1 else w for i, w in enumerate(left)]
                p[f"key{n}"], p[f"form{n}"] = "".join(words[-n:]), "".join(left)
        return p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("core", pa.string()), ("kind", pa.string()), ("bare", pa.bool_()), ("said", pa.bool_())])
        where = pa.struct([(k, pa.string()) for k in ("whole", "key1", "form1", "key2", "form2")])
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for name, city, state in zip(*(b.column(c).to_pylist() for c in ("name", "city", "state"))):
                plain = read_name(name)
                turned = [] if any(r.said for r in plain[:1]) else read_name(city)
                nw, cw = _words(name or ""), _words(city or "")
                whole = "".join(nw)
                rest = lambda rs: rs[0].rest if rs else []
                reading = lambda rs: [{"core": r.core, "kind": r.kind, "bare": r.bare, "said": r.said} for r in rs if r.core]
                for o, v in zip(out, (reading(plain), reading(turned), place(cw), place(nw), place(rest(plain)), place(rest(turned)), "".join(_words(state or "")), whole, whole not in NO_VALUE)):
                    o.append(v)
            kinds = [pa.list_(struct), pa.list_(struct), where, where, where, where, pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("tid"), *[pa.array(o, k) for o, k in zip(out, kinds)]], names=["tid", "plain", "turned", "p0", "p1", "p2", "p3", "skey", "whole", "named"])

    return triples.mapInArrow(run, f"tid long, plain {_READING}, turned {_READING}, p0 {_PLACE}, p1 {_PLACE}, p2 {_PLACE}, p3 {_PLACE}, skey string, whole string, named boolean")


def _placed(read: DataFrame, entries: DataFrame) -> DataFrame:
    """(tid, place0, state0, place1, state1): the place and the state that a triple's fields say, read plainly and with name and city turned."""
    ways = small(entries.select("state", F.explode("states").alias("way")).groupBy("way").agg(F.min("state").alias("known")))
    key = lambda slot, n, k, form: F.struct(F.lit(slot).alias("slot"), F.lit(n).alias("n"), k.alias("key"), form.alias("form"))
    keys = [key(i, n, F.col(f"p{i}.key{n}") if n else F.lit(None).cast("string"), F.col(f"p{i}.form{n}") if n else F.col(f"p{i}.whole")) for i in range(4) for n in (0, 1, 2)]
    rows = read.select("tid", F.explode(F.array(*keys, key(4, 0, F.nullif("skey", F.lit("")), F.lit("")))).alias("k")).select("tid", "k.*").filter("form is not null")
    rows = rows.join(ways, F.col("key") == F.col("way"), "left").filter("n = 0 or known is not null")
    got = rows.groupBy("tid").agg(*[F.max(F.when(F.col("slot") == i, F.struct("n", "form", "known"))).alias(f"s{i}") for i in range(5)])
    said = lambda c: F.nullif(c, F.lit(""))
    out = ["tid"]
    for v, (own, rest) in enumerate(((0, 2), (1, 3))):
        out += [F.coalesce(said(F.col(f"s{own}.form")), said(F.col(f"s{rest}.form"))).alias(f"place{v}"), F.coalesce("s4.known", f"s{own}.known", f"s{rest}.known").alias(f"state{v}")]
    return got.select(*out)


_BUILT: dict[str, dict[str, BKTree]] = {}


def _trees(roles: list[str], forms: list[str]) -> dict[str, BKTree]:
    out: dict[str, BKTree] = {}
    for r, f in zip(roles, forms):
        out.setdefault(r, BKTree()).add(f, 0)
    return out


def _answered(trees: dict[str, BKTree], role: list[str], form: list[str], most: list[int]) -> pa.RecordBatch:
    """(role, query, form, d) of all queries; those of one role and about one length together, so that a long text doesn't slow the others."""
    groups: dict[tuple[str, bool], list[int]] = {}
    for i, (r, f) in enumerate(zip(role, form)):
        groups.setdefault((r, len(f) > 64), []).append(i)
    found: list[tuple[int, int, str]] = []
    for (r, _), at in groups.items():
        if r in trees:
            found += [(at[q], d, f) for q, d, f, _ in trees[r].within_many([form[i] for i in at], [most[i] for i in at])]
    cols = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array([role[i] for i in cols[0]], pa.string()), pa.array([form[i] for i in cols[0]], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[1], pa.int32())], names=["role", "query", "form", "d"])


def search(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """(role, query, form, d): for each query (role, query, most) every form (role, form) of its role at a distance of most at most."""
    forms, queries = forms.select("role", "form").distinct(), queries.select("role", "query", "most").distinct()
    schema, ctx = "role string, query string, form string, d int", forms.sparkSession.sparkContext
    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = forms.limit(SHARD + 1).collect()
    if len(rows) <= SHARD:
        sent, token = ctx.broadcast(([r["role"] for r in rows], [r["form"] for r in rows])), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if token not in _BUILT:  # once for all tasks of a worker
                while len(_BUILT) >= 2:
                    _BUILT.pop(next(iter(_BUILT)))
                _BUILT[token] = _trees(*sent.value)
            for b in batches:
                yield _answered(_BUILT[token], *(b.column(c).to_pylist() for c in ("role", "query", "most")))

        return queries.repartition(parts, "query").mapInArrow(run, schema)
    queries, forms = settled(queries), settled(forms)
    shards, slices = -(-forms.count() // SHARD), max(-(-queries.count() // QUERIES), 1)
    left = queries.withColumn("slice", F.pmod(F.xxhash64("query", "role"), F.lit(slices)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = forms.withColumn("shard", F.pmod(F.xxhash64("form", "role"), F.lit(shards)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def meet(q: pa.Table, f: pa.Table) -> pa.Table:
        trees = _trees(f.column("role").to_pylist(), f.column("form").to_pylist())
        return pa.Table.from_batches([_answered(trees, *(q.column(c).to_pylist() for c in ("role", "query", "most")))])

    return left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(meet, schema)


def _reach(n: Column) -> Column:
    return F.when(n < 3, 0).when(n < 5, 1).when(n < 8, 2).when(n < 12, 3).otherwise(4)


def _readings_of(read: DataFrame) -> DataFrame:
    """(tid, v, core, kind, bare, said): one row a reading; v is 1 for those of the city."""
    one = lambda v: lambda r: F.struct(F.lit(v).alias("v"), *[r[c].alias(c) for c in ("core", "kind", "bare", "said")])
    return read.select("tid", F.explode(F.array_distinct(F.concat(F.transform("plain", one(0)), F.transform("turned", one(1))))).alias("r")).select("tid", "r.*")


def _asked(core: Column, bare: Column) -> Column:
    """(role, query, most) of the trees that a reading asks: all names within reach and one more, names that it begins, and for one without vowels the names' consonants."""
    row = lambda role, form, most: F.struct(F.lit(role).alias("role"), form.alias("query"), most.cast("int").alias("most"))
    bones = F.regexp_replace(core, "[aeiou]", "")
    return F.array_compact(F.array(row("name", core, _reach(F.length(core)) + 1), F.when(F.length(core) >= 4, row("head", core, F.lit(0))), F.when(bare & (bones != ""), row("bones", bones, F.when(F.length(bones) < 5, 0).otherwise(1)))))


def _queries(read: DataFrame, info: DataFrame) -> DataFrame:
    """(role, query, most) of all forms that the triples' fields may mean."""
    row = lambda role, form, most: F.struct(F.lit(role).alias("role"), form.alias("query"), most.cast("int").alias("most"))
    place = lambda c: [row("city", F.col(c), _reach(F.length(c))), F.when(F.length(c) >= 4, row("cityhead", F.col(c), F.lit(0)))]
    one = _readings_of(read).select(F.explode(_asked(F.col("core"), F.col("bare"))).alias("q"))
    two = info.select(F.explode(F.array_compact(F.array(*place("place0"), *place("place1"), row("code", F.col("whole"), F.lit(0))))).alias("q"))
    return one.unionByName(two).select("q.*").filter("query != ''").distinct()


def resolved(triples: DataFrame, reference: DataFrame, codes: list[str] = []) -> DataFrame:
    """(tid, entry_id): the entry that each of the triples (tid, name, city, state) denotes; triples that denote none, or several equally, are left out."""
    entries = settled(entry_forms(reference, codes))
    read = settled(_read(triples))
    info = settled(_placed(read, entries).join(read.select("tid", "named", "whole", (F.size("plain") > 0).alias("n0")), "tid"))
    forms = _forms(entries)
    hits = search(_queries(read, info), forms).join(small(forms), ["role", "form"])
    hits = settled(hits.select("role", "query", "target", "d"))
    role = F.col("role")
    # names: the distance of vowelless names counts one more, that of a name cut off is two
    cores = hits.filter(role.isin("name", "bones", "head")).select("role", "query", "target", F.when(role == "bones", F.col("d") + 1).when(role == "head", 2).otherwise(F.col("d")).alias("d"))
    asked = _readings_of(read).select("tid", "v", "core", "kind", "said", F.explode(_asked(F.col("core"), F.col("bare"))).alias("q")).select("tid", "v", "core", "kind", "said", "q.role", "q.query")
    names = asked.join(cores, ["role", "query"]).select("tid", "v", "core", "kind", "said", "target", "d").repartition("tid")
    names = names.groupBy("tid", "v", "core", "kind", "said", "target").agg(F.min("d").alias("d"))
    # the fields are turned if the city reads as the name of a known place with its kind
    turn = F.max(((F.col("v") == 1) & F.col("said") & F.col("kind").isNotNull()).cast("int")).over(Window.partitionBy("tid"))
    names = names.withColumn("turn", turn).filter("v = turn")
    near = hits.filter(role.isin("city", "cityhead")).groupBy(F.col("query").alias("place"), F.col("target").alias("city")).agg(F.min(F.when(role == "cityhead", 2).otherwise(F.col("d"))).alias("dc"))
    listed = entries.select("id", F.col("core").alias("target"), F.col("kind").alias("e_kind"), "city", "state").filter("target != ''")
    where = info.select("tid", "place0", "state0", "place1", "state1")
    c = names.join(where, "tid").select("tid", "kind", "target", "d", F.when(F.col("v") == 1, F.col("place1")).otherwise(F.col("place0")).alias("place"), F.when(F.col("v") == 1, F.col("state1")).otherwise(F.col("state0")).alias("st"))
    c = c.join(listed, "target").filter("kind is null or kind <=> e_kind").join(near, ["place", "city"], "left")
    n, d, here, same = F.length("target"), F.col("d"), F.col("dc").isNotNull(), F.coalesce(F.col("state") == F.col("st"), F.lit(False))
    # a name off by more needs its place to agree; against a place that disagrees it must be nearly right
    clash = F.col("place").isNotNull() & ~here & ~(same & (n >= 8))
    most = F.when(here, _reach(n) + 1).when(same & (n >= 8), 2).when(clash | (n < 8), 1).otherwise(2)
    penalty = d + F.when(F.col("kind").isNull(), 0.2).otherwise(0.0) - F.when(here, 1.5 - 0.3 * F.col("dc")).otherwise(0.0) - F.when(same, 1.0).otherwise(0.0)
    by_name = c.filter(d <= most).select("tid", "id", penalty.cast("double").alias("p"))
    # a city alone, where no name is given; a name that isn't readable still names another place. Any name beats it
    alone = info.filter("not named and not n0 and place0 is not null").select("tid", F.col("place0").alias("place"), F.col("state0").alias("st")).join(near, "place").join(entries.select("id", "city", "state"), "city")
    by_city = alone.filter(F.col("dc") <= F.when(same & (F.length("city") >= 6), 2).otherwise(1)).select("tid", "id", (10 + F.col("dc") - F.when(same, 1.0).otherwise(0.0)).cast("double").alias("p"))
    # a code says it all
    coded = entries.select("id", F.explode("codes").alias("code")).groupBy("code").agg(F.min("id").alias("id"))
    known = hits.filter(role == "code").select(F.col("query").alias("whole"), F.col("target").alias("code")).join(coded, "code")
    by_code = info.filter("n0").join(known, "whole").select("tid", "id", F.lit(-1000.0).alias("p"))
    every = by_name.unionByName(by_city).unionByName(by_code).repartition("tid").groupBy("tid", "id").agg(F.min("p").alias("p"))
    two = every.withColumn("place", F.row_number().over(Window.partitionBy("tid").orderBy("p", "id"))).filter("place <= 2")
    best = two.groupBy("tid").agg(F.min("p").alias("p"), F.min(F.when(F.col("place") == 1, F.col("id"))).alias("entry_id"), F.max("p").alias("next"), F.count(F.lit(1)).alias("n"))
    return best.filter((F.col("n") == 1) | (F.col("next") - F.col("p") >= CLEAR)).select("tid", "entry_id")


def map_to_entries(df: DataFrame, name: str, city: str, state: str, reference: DataFrame, codes: list[str] = [], keep: list[str] | None = None) -> DataFrame:
    """df (the columns in keep, all by default) with entry_id, the reference entry that the three typed fields denote, or null for none or no single one.

    reference: columns id, name, city, state, full_state and the named code columns; entries without id are left out. Each different triple is decided once and joined back to its rows, spread where many rows share it. Null and
    empty fields say nothing; repeated rows give the same answer. An empty list leaves every row without entry. A column entry_id of df is replaced.
    """
    keep = [c for c in (keep or df.columns) if c != "entry_id"]
    typed = {k: F.col(c).cast("string") for k, c in (("name", name), ("city", city), ("state", state))}
    # a null and an empty text aren't the same
    tid = F.xxhash64(*[x for c in typed.values() for x in (c, c.isNull())])
    rows = df.select(*keep, tid.alias("_tid"), *[c.alias(f"_{k}") for k, c in typed.items()])
    triples = rows.select(F.col("_tid").alias("tid"), *[F.col(f"_{k}").alias(k) for k in typed]).distinct()
    found = settled(resolved(triples, reference, codes).withColumnRenamed("tid", "_tid"))
    return spread_lookup(rows.select(*keep, "_tid"), found, "_tid").drop("_tid")


def closest(values: DataFrame, value: str, forms: DataFrame, form: str) -> DataFrame:
    """(value, form, distance): for each distinct value every form of the list within reach, in lower case; unmatched values come out with nulls. Null values are left out."""
    distinct = values.filter(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.lower(value).alias("query")).distinct()
    listed = forms.filter(F.col(form).isNotNull()).select(F.col(form).alias("as_listed"), F.lower(form).alias("form")).distinct()
    asked = distinct.select(F.lit("form").alias("role"), "query", _reach(F.length("query")).cast("int").alias("most"))
    hits = search(asked, listed.select(F.lit("form").alias("role"), "form")).join(listed, "form").select("query", F.col("as_listed").alias("form"), F.col("d").alias("distance"))
    return distinct.join(hits, "query", "left").select("value", "form", "distance")
