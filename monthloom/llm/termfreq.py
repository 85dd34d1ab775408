"""How often every distinct term occurs and in how many records, from a vertical layout.

Each term has, per block of record identifiers, a compressed set of the records that hold it and, parallel to it, a counter of occurrences per record. A set
is a sorted array of 16-bit places, or a bitmap where that is smaller. Sets of one term and block are merged by union, under which a re-sent
record counts once; document frequencies are read from their sizes. Only sets travel, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Bits of an identifier that a block keeps; the rest names the block.
BLOCK_BITS = 15
#: Pairs of term and record that a task gathers before it writes their sets out.
GATHER = 3_000_000
#: The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANKS = str.maketrans(PUNCTUATION, " " * len(PUNCTUATION))
_BITMAP = (1 << BLOCK_BITS) // 8


def tokens(text: str) -> list[str]:
    """The maximal runs without white space after lower-casing and turning punctuation marks into spaces."""
    return text.lower().translate(_BLANKS).split()


def packed_set(places: np.ndarray) -> bytes:
    """A set of places below 2 ** BLOCK_BITS, sorted: as an array or, if that is smaller, as a bitmap."""
    if 2 * len(places) < _BITMAP:
        return places.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    """The reverse of packed_set."""
    if len(data) == _BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(data, "<u2")


def _sets(field: np.ndarray, term: np.ndarray, rec: np.ndarray, n: np.ndarray, words: pa.Array, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per field, term and block from the gathered pairs; equal pairs (a record seen twice) keep their largest counter."""
    hi, lo = rec >> BLOCK_BITS, (rec & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    order = np.lexsort((n, lo, hi, term, field))
    field, term, hi, lo, n = field[order], term[order], hi[order], lo[order], n[order]
    new = np.ones(len(field), bool)
    new[1:] = (field[1:] != field[:-1]) | (term[1:] != term[:-1]) | (hi[1:] != hi[:-1])
    last = np.ones(len(field), bool)
    last[:-1] = new[1:] | (lo[1:] != lo[:-1])
    begin = np.flatnonzero(new)
    owner = (np.cumsum(new) - 1)[last]
    lo, n = lo[last], n[last]
    size = np.bincount(owner, minlength=len(begin))
    at = np.concatenate([[0], np.cumsum(size)])
    small = np.minimum(n, 255).astype(np.uint8)
    names = pa.array(fields)
    for s in range(0, len(begin), 20_000):
        e = min(len(begin), s + 20_000)
        a, b = at[s], at[e]
        if (2 * size[s:e] < _BITMAP).all():  # all arrays: one buffer for the batch
            sets = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(((at[s : e + 1] - a) * 2).astype(np.int32).tobytes()), pa.py_buffer(lo[a:b].astype("<u2").tobytes())])
        else:
            sets = pa.array([packed_set(lo[at[i] : at[i + 1]]) for i in range(s, e)], pa.binary())
        counts = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((at[s : e + 1] - a).astype(np.int32).tobytes()), pa.py_buffer(small[a:b].tobytes())])
        # counters that a byte can't hold stand beside it, with their places
        over: list[bytes | None] = [None] * (e - s)
        for i in np.unique(owner[a:b][n[a:b] >= 255]).tolist():
            lo_i, n_i = lo[at[i] : at[i + 1]], n[at[i] : at[i + 1]]
            over[i - s] = np.stack([lo_i[n_i >= 255].astype("<u4"), n_i[n_i >= 255].astype("<u4")], 1).tobytes()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(field[begin[s:e]])), words.take(pa.array(term[begin[s:e]])), pa.array(hi[begin[s:e]]), sets, counts, pa.array(over, pa.binary())], names=["field_name", "term", "block", "places", "counts", "over"])


_SETS = "field_name string, term string, block long, places binary, counts binary, over binary"


def term_sets(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field_name, term, block, places, counts, over): the partial sets of every task. The null term holds the records whose field isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, total = [], pa.array([None], pa.string()), 0
        codes: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                f, t, r, n = (np.concatenate(x) for x in zip(*held))
                yield from _sets(f, t, r, n, pa.array([None, *codes], pa.string()), fields)
                held.clear()
                codes.clear()

        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in range(len(fields)):
                    texts = b.column(i + 1)
                    there = np.flatnonzero(np.asarray(texts.is_valid()))
                    if not len(there):
                        continue
                    lists = [tokens(x) for x in texts.take(pa.array(there)).to_pylist()]
                    size = np.fromiter(map(len, lists), np.int64, len(lists))
                    coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
                    local = np.fromiter((codes.setdefault(w, len(codes) + 1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                    term = coded.indices.to_numpy().astype(np.int64)
                    pair, n = np.unique(np.repeat(np.arange(len(lists)), size) * max(len(local), 1) + term, return_counts=True)
                    rec = ids[there]
                    held.append((np.full(len(rec), i, np.int8), np.zeros(len(rec), np.int64), rec, np.ones(len(rec), np.int64)))
                    if len(pair):
                        held.append((np.full(len(pair), i, np.int8), local[pair % len(local)], rec[pair // len(local)], n.astype(np.int64)))
                    total += len(pair) + len(rec)
                if total > GATHER:
                    yield from flush()
                    total = 0
        yield from flush()

    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), *fields).mapInArrow(run, _SETS)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and occurrences of the unions; the rows come sorted by field, term and block. A group is carried on to the next batch until it ends."""
    tail: pa.Table | None = None
    for b in chain(batches, [None]):
        t = tail if b is None else pa.Table.from_batches([b] if tail is None else [*tail.to_batches(), b])
        if t is None or not t.num_rows:
            continue
        t = t.combine_chunks()
        f, w, blk = (t.column(c).combine_chunks() for c in ("field_name", "term", "block"))
        code = [np.asarray(pc.fill_null(pc.cast(x.dictionary_encode().indices, pa.int64()), -1)) if pa.types.is_string(x.type) else x.to_numpy() for x in (f, w, blk)]
        new = np.ones(len(f), bool)
        new[1:] = (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1]) | (code[2][1:] != code[2][:-1])
        begin = np.flatnonzero(new)
        end = t.num_rows
        if b is not None:  # the last group may go on
            end, begin = begin[-1], begin[:-1]
            tail = t.slice(end)
        if not len(begin):
            continue
        group = (np.cumsum(new) - 1)[:end]
        places, counts = t.column("places").combine_chunks().slice(0, end), t.column("counts").combine_chunks().slice(0, end)
        width = np.asarray(pc.binary_length(places))
        offsets = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + end + 1]
        if (width != _BITMAP).all():
            raw = np.frombuffer(places.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            lo, per = np.frombuffer(raw.tobytes(), "<u2"), width // 2
        else:
            sets = [unpacked_set(x) for x in places.to_pylist()]
            lo, per = np.concatenate(sets), np.array([len(x) for x in sets])
        co = np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + end + 1]
        n = np.frombuffer(counts.buffers()[2], np.uint8)[co[0] : co[-1]].astype(np.int64)
        starts = np.cumsum(per) - per
        over = t.column("over").combine_chunks().slice(0, end)
        if over.null_count < end:
            n = n.copy()
            for i in np.flatnonzero(np.asarray(over.is_valid())).tolist():
                big = np.frombuffer(over[i].as_py(), "<u4").reshape(-1, 2)
                n[starts[i] + np.searchsorted(lo[starts[i] : starts[i] + per[i]], big[:, 0])] = big[:, 1]
        owner = np.repeat(group, per)
        parts = np.bincount(group, minlength=len(begin))
        df, occ = np.bincount(owner, minlength=len(begin)), np.bincount(owner, weights=n, minlength=len(begin))
        if (parts > 1).any():  # only where sets meet can records meet
            meet = parts[owner] > 1
            o, l, c = owner[meet], lo[meet], n[meet]
            order = np.lexsort((c, l, o))
            o, l, c = o[order], l[order], c[order]
            last = np.ones(len(o), bool)
            last[:-1] = (o[1:] != o[:-1]) | (l[1:] != l[:-1])
            many = parts > 1
            df = np.where(many, np.bincount(o[last], minlength=len(begin)), df)
            occ = np.where(many, np.bincount(o[last], weights=c[last], minlength=len(begin)), occ)
        yield pa.RecordBatch.from_arrays([f.take(pa.array(begin)), w.take(pa.array(begin)), pa.array(df.astype(np.int64)), pa.array(occ.astype(np.int64))], names=["field_name", "term", "df", "occ"])
        if b is None:
            tail = None


def term_frequencies(df: DataFrame, key: str, fields: list[str], rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """(field_name, term, n_occurrences, n_records, freq_mark): every distinct term of every field.

    freq_mark is `rare` below rare_below records, `common` above the share common_above of the records whose field isn't null, else null;
    rare wins where both hold. Records are told apart by an integer key: rows that repeat a key count once, in each term with their largest counter. Rows without key are left out; null texts
    hold no term and don't count as records of the field, empty texts do. A hot term is spread over blocks of 2 ** 15 identifiers.
    """
    sets = term_sets(df, key, fields)
    merged = sets.repartition("field_name", "term", "block").sortWithinPartitions("field_name", "term", "block").mapInArrow(_union, "field_name string, term string, df long, occ long")
    per_term = settled(merged.groupBy("field_name", "term").agg(F.sum("df").alias("n_records"), F.sum("occ").alias("n_occurrences")))
    records = per_term.filter("term is null").select("field_name", F.col("n_records").alias("_all"))  # one row a field
    out = per_term.filter("term is not null").join(F.broadcast(records), "field_name")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * F.col("_all"), "common")
    return out.select("field_name", "term", "n_occurrences", "n_records", mark.alias("freq_mark"))
