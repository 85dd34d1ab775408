"""Held-out passages found in a corpus by latent semantic retrieval, then checked word by word.

Texts are cut into overlapping passages of words in their one form. Passages are weighted by TF-IDF over the words of the held-out items, with document
frequencies of the whole corpus; a randomised SVD, whose sums over passages are made where the passages lie, gives a latent space. There every passage of the corpus
is compared by cosine with the items' passages near it: these are indexed by the nearest of some centres, and those of the nearest centres are looked at. A candidate is then compared with its
item by longest common subsequence and, place by place, against the definition of a leak.

A passage can hold part of a leak only if nearly all its words occur in the items, so others are dropped before anything is weighted; this loses no leak.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settled
from .lookalike import _slices, one_form

#: Words of a leak at least, and the share of them that must be unchanged.
LEAST_WORDS, SHARE = 20, 0.9
#: Words of a passage and the steps between passages of items and documents.
WINDOW, ITEM_STEP, DOC_STEP = 20, 1, 2
#: Any stretch of up to 39 words with a tenth changed has at most three changed words; so a passage inside one knows all but three of its words.
KNOWN = WINDOW - 3
#: Rank of the latent space, more columns than that for the sketch, least cosine of a candidate.
RANK, EXTRA, COSINE = 96, 16, 0.7
#: Passages that a sum of the sketch holds at once.
AT_ONCE = 1_024
#: Items whose words one pass over the corpus looks for, and items that one latent space holds; more are taken block by block, the latter over the stretches that the pass kept.
SCANNED, MOST_ITEMS = 20_000, 2_000
#: The share of the index's centres that are looked at, and how many at least; item passages that the centres are fitted on at most (the index holds all); rounds of fitting.
LOOKED_AT, LEAST_CENTRES, FITTED, FITS = 0.1, 8, 50_000, 4
#: Passages of documents that are compared at once.
COMPARED = 8_192


@dataclass
class Items:
    """A block of held-out items: ids, words as numbers, the vocabulary."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[object, str]]) -> "Items":
        forms = one_form(pa.array([t for _, t in rows], pa.string()), words_only=True).to_pylist()
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in (f or "").split()], np.int32) for f in forms]
        return cls([i for i, _ in rows], words, vocabulary)

    def parts(self, size: int) -> Iterator[tuple["Items", np.ndarray]]:
        """Items of so many at a time with word numbers of their own, and for each the numbers of its words here."""
        for i in range(0, len(self.ids), size):
            words = self.words[i : i + size]
            mine = np.unique(np.concatenate([*words, np.zeros(0, np.int32)]))
            yield Items(self.ids[i : i + size], [np.searchsorted(mine, w).astype(np.int32) for w in words], dict.fromkeys(mine.tolist(), 0)), mine

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """(passages of WINDOW words as rows, the item each is from)."""
        out, of = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)]
        for k, w in enumerate(self.words):
            if len(w) >= WINDOW:
                at = np.unique(np.append(np.arange(0, len(w) - WINDOW + 1, ITEM_STEP), len(w) - WINDOW))
                out.append(w[at[:, None] + np.arange(WINDOW)])
                of.append(np.full(len(at), k))
        return np.concatenate(out), np.concatenate(of)


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (from, to) of a document that passages with enough known words cover; -1 is an unknown word."""
    if len(words) < WINDOW:
        return []
    known = np.concatenate([[0], np.cumsum(words >= 0)])
    good = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= KNOWN)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > 1)
    return list(zip(good[np.concatenate([[0], cut + 1])].tolist(), (good[np.concatenate([cut, [len(good) - 1]])] + WINDOW).tolist()))


def spans(df: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """(key, words): the stretches of documents that may hold a leak, as word numbers; and rows with a null key that count, per word, the documents that hold it."""
    sent = df.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        held = np.zeros(len(vocabulary) + 1, np.int64)
        for whole in batches:
            for b in _slices(whole, 1):
                ids, out = b.column(0), []
                for k, form in enumerate(one_form(b.column(1), words_only=True).to_pylist()):
                    ws = form.split()
                    w = np.fromiter((vocabulary.get(x, -1) for x in ws), np.int32, len(ws))
                    held[np.unique(w[w >= 0])] += 1
                    held[-1] += 1
                    out += [(k, w[s:e]) for s, e in stretches(w)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([k for k, _ in out], pa.int64())), pa.array([w for _, w in out], pa.list_(pa.int32()))], names=[key, "words"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, df_type), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))], names=[key, "words"])

    df_type = to_arrow_type(df.schema[key].dataType)
    return df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, words array<int>")


def narrowed(spans_: DataFrame, key: str, mine: np.ndarray, n_words: int) -> DataFrame:
    """The stretches that may hold a leak of some of the items, in the word numbers of those."""
    local = np.full(n_words + 1, -1, np.int32)
    local[mine] = np.arange(len(mine))
    sent = spans_.sparkSession.sparkContext.broadcast(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, w[s:e]) for k, x in enumerate(b.column(1)) for w in [sent.value[np.asarray(x.values)]] for s, e in stretches(w)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in out], pa.int64())), pa.array([w for _, w in out], pa.list_(pa.int32()))], names=[key, "words"])

    return spans_.select(key, "words").mapInArrow(run, spans_.select(key, "words").schema)


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, their places) of a stretch; the last one ends with it."""
    last = len(words) - WINDOW
    at = np.unique(np.concatenate([np.arange(0, last + 1, DOC_STEP), [last]]))
    return words[at[:, None] + np.arange(WINDOW)], at


def weighted(passages: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The unit vectors of passages in the space of basis (words x rank); unknown words weigh nothing. Rows are TF-IDF of unit length before."""
    safe = np.where(passages >= 0, passages, 0)
    w = np.where(passages >= 0, idf[safe], 0.0).astype(np.float32)
    out = np.zeros((len(passages), basis.shape[1]), np.float32)
    for j in range(passages.shape[1]):
        out += w[:, j, None] * basis[safe[:, j]]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _sketch(spans_: DataFrame, idf: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(A' A) q summed over the passages A of the corpus, each task for its own, and of the items."""
    sent = spans_.sparkSession.sparkContext.broadcast((idf, q))

    def part(passages: np.ndarray, idf: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
        safe = np.where(passages >= 0, passages, 0)
        w = np.where(passages >= 0, idf[safe], 0.0)
        w /= np.maximum(np.sqrt((w**2).sum(1, keepdims=True)), 1e-9)
        y = np.zeros((len(passages), q.shape[1]))
        for j in range(passages.shape[1]):
            y += w[:, j, None] * q[safe[:, j]]
        for j in range(passages.shape[1]):
            np.add.at(total, safe[:, j], w[:, j, None] * y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = sent.value
        total = np.zeros(q.shape)
        for b in batches:
            for w in b.column(0):
                p, _ = _windows(np.asarray(w.values))
                for i in range(0, len(p), AT_ONCE):
                    part(p[i : i + AT_ONCE], idf, q, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["word", "v"])

    sums = spans_.select("words").mapInArrow(run, "word int, v array<double>").groupBy("word").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(q.shape[1])])
    rows = sums.toPandas().set_index("word")  # words x columns, bounded by the items
    out = np.zeros(q.shape)
    out[rows.index.to_numpy()] = rows.to_numpy()
    for i in range(0, len(own), AT_ONCE):
        part(own[i : i + AT_ONCE], idf, q, out)
    return out


def latent_basis(spans_: DataFrame, idf: np.ndarray, own: np.ndarray, seed: int = 7) -> np.ndarray:
    """Words x rank: the right singular vectors of the TF-IDF passages by a randomised range finder with one power step."""
    n = len(idf)
    k = min(n, RANK + EXTRA)
    if n <= RANK:
        return np.eye(n, dtype=np.float32)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))[0]
    q = np.linalg.qr(_sketch(spans_, idf, q, own))[0]
    small = q.T @ _sketch(spans_, idf, q, own)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a.tolist()):
        masks[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def leaks(doc: np.ndarray, item: np.ndarray) -> bool:
    """Whether doc holds at least LEAST_WORDS words in a row of item, of which at least SHARE are unchanged and in place.

    A longer stretch has a part of LEAST_WORDS to twice that less one with the same share, so only those lengths are looked at.
    """
    n, m = len(doc), len(item)
    if n < LEAST_WORDS or m < LEAST_WORDS:
        return False
    # row o holds, for the doc's place o - m + LEAST_WORDS against the item's first word, which words agree
    off = np.arange(-(m - LEAST_WORDS), n - LEAST_WORDS + 1)
    at = off[:, None] + np.arange(m)[None, :]
    inside = (at >= 0) & (at < n)
    there = doc[np.clip(at, 0, n - 1)]
    c = np.zeros((len(off), m + 1), np.int16)
    np.cumsum((there == item) & inside & (there >= 0), axis=1, out=c[:, 1:])
    # a stretch of up to 39 words with its share has LEAST_WORDS words in a row that lack three at most
    hopeful = ((c[:, LEAST_WORDS:] - c[:, :-LEAST_WORDS]) >= LEAST_WORDS - 3).any(axis=1)
    if not hopeful.any():
        return False
    c, inside = c[hopeful], np.cumsum(np.pad(inside[hopeful], ((0, 0), (1, 0))), axis=1)
    for length in range(LEAST_WORDS, min(2 * LEAST_WORDS, m + 1)):
        whole = (inside[:, length:] - inside[:, :-length]) == length
        if (whole & (10 * (c[:, length:] - c[:, :-length]).astype(np.int32) >= round(10 * SHARE) * length)).any():
            return True
    return False


@dataclass
class Index:
    """Unit vectors by the nearest of some centres."""

    vectors: np.ndarray
    centres: np.ndarray
    #: For each centre the places of its vectors.
    lists: list[np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray, seed: int = 11) -> "Index":
        n = max(1, round(len(vectors) ** 0.5))
        rnd = np.random.default_rng(seed)
        some = vectors if len(vectors) <= FITTED else vectors[rnd.choice(len(vectors), FITTED, replace=False)]
        centres = some[rnd.choice(len(some), n, replace=False)].copy()
        for _ in range(FITS):
            near = cls._nearest(some, centres)
            sums, held = np.zeros_like(centres), np.bincount(near, minlength=n)
            there = held > 0
            sums[there] = np.add.reduceat(some[np.argsort(near, kind="stable")], (np.cumsum(held) - held)[there])
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
        near = cls._nearest(vectors, centres)
        order = np.argsort(near, kind="stable")
        return cls(vectors, centres, np.split(order, np.searchsorted(near[order], np.arange(1, n))))

    @staticmethod
    def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(vectors[i : i + COMPARED] @ centres.T, axis=1) for i in range(0, len(vectors), COMPARED)])

    def near(self, asked: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(asked, vector) of the pairs with a cosine of at least least, among the vectors of the centres looked at."""
        n = len(self.centres)
        k = min(n, max(LEAST_CENTRES, round(LOOKED_AT * n)))
        looked = np.argpartition(-(asked @ self.centres.T), k - 1, axis=1)[:, :k]
        order = np.argsort(looked.ravel(), kind="stable")
        bounds = np.searchsorted(looked.ravel()[order], np.arange(n + 1))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, at in enumerate(self.lists):
            who = order[bounds[c] : bounds[c + 1]] // k
            if len(who) and len(at):
                i, j = np.nonzero(asked[who] @ self.vectors[at].T >= least)
                xs.append(who[i])
                ys.append(at[j])
        return np.concatenate(xs), np.concatenate(ys)


def _search(sent, key: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis, index, of = sent.value
        for b in batches:
            found = []
            stretch = [np.asarray(w.values) for w in b.column(1)]
            start = 0
            while start < len(stretch):
                end, n = start, 0
                while end < len(stretch) and (n == 0 or n + len(stretch[end]) // DOC_STEP <= COMPARED):
                    n += len(stretch[end]) // DOC_STEP
                    end += 1
                part = stretch[start:end]
                cut = [_windows(w) for w in part]
                passages = np.concatenate([p for p, _ in cut])
                owner = np.repeat(np.arange(len(part)), [len(p) for p, _ in cut])
                place = np.concatenate([at for _, at in cut])
                near: dict[tuple[int, int], list[int]] = defaultdict(list)
                for x in range(0, len(passages), COMPARED):
                    i, j = index.near(weighted(passages[x : x + COMPARED], idf, basis), COSINE)
                    for w, it in np.unique(np.stack([i + x, of[j]]), axis=1).T.tolist():
                        near[int(owner[w]), it].append(int(place[w]))
                for (o, it), at in near.items():
                    item, doc = items.words[it], part[o]
                    # the candidate passages lie together or apart; each cluster is looked at with the item's length around it
                    at.sort()
                    lo = at[0]
                    for a, nxt in zip(at, [*at[1:], None]):
                        if nxt is None or nxt - a > len(item):
                            piece = doc[max(0, lo - len(item)) : a + WINDOW + len(item)]
                            if common_subsequence(item, piece) >= SHARE * LEAST_WORDS and leaks(piece, item):
                                found.append((start + o, it))
                                break
                            lo = nxt
                start = end
            pick = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([items.ids[i] for _, i in found], id_type), b.column(0).take(pick)], names=["item_id", key])

    return run


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(item_id, key): each document with each item of which it holds LEAST_WORDS words or more.

    Letter case, punctuation, white space and the form of the characters make no difference. Items of fewer words leak nowhere; null and empty texts hold nothing; extra
    columns are ignored; repeated rows of a document give one pair; keys may be of any type, those of a table that are null are left out. items is a held-out set: SCANNED items at a time are looked
    for in one pass over all documents, which keeps the stretches that nearly all consist of their words; the search reads those only.
    """
    spark = docs.sparkSession
    id_kind, kind = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    known = items.filter(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).orderBy("k")
    blocks, rows = [], []
    for r in known.toLocalIterator():
        rows.append((r["k"], r["t"]))
        if len(rows) == SCANNED:
            blocks, rows = [*blocks, Items.of(rows)], []
    if rows:
        blocks.append(Items.of(rows))
    id_type = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for block in blocks:
        if not len(block.passages()[0]):
            continue
        held = settled(spans(docs, key, text, block))
        counts = held.filter(F.col(key).isNull()).select(F.posexplode("words").alias("j", "n")).groupBy("j").agg(F.sum("n").alias("n")).collect()  # one row a word of the items
        df = np.zeros(len(block.vocabulary) + 1)
        for r in counts:
            df[r["j"]] = r["n"]
        every = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
        n = max(held.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        real = held.filter(F.col(key).isNotNull()).repartition(n)
        for it, mine in block.parts(MOST_ITEMS):
            own, of = it.passages()
            if not len(own):
                continue
            some = real if len(block.ids) <= MOST_ITEMS else settled(narrowed(real, key, mine, len(block.vocabulary)))
            idf = every[mine]
            basis = latent_basis(some, idf, own)
            sent = spark.sparkContext.broadcast((it, idf, basis, Index.of(weighted(own, idf, basis)), of))
            part = some.select(key, "words").mapInArrow(_search(sent, key, id_type), f"item_id {id_kind}, `{key}` {kind}")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_kind}, `{key}` {kind}")
    return out.distinct()


def brute_force(docs: list[tuple[object, str]], items: list[tuple[object, str]]) -> set[tuple[object, object]]:
    """All leaks of small tables, by comparing every document with every item; for tests."""
    it = Items.of(items)
    out = set()
    forms = one_form(pa.array([t for _, t in docs], pa.string()), words_only=True).to_pylist()
    for (d, _), form in zip(docs, forms):
        w = np.array([it.vocabulary.get(x, -1) for x in (form or "").split()], np.int32)
        have = Counter(w.tolist())
        for k, i in enumerate(it.ids):
            if sum((have & Counter(it.words[k].tolist())).values()) >= SHARE * LEAST_WORDS and leaks(w, it.words[k]):
                out.add((i, d))
    return out
