import random
from collections import Counter

import numpy as np
import pytest

from monthloom.llm import termfreq as t


def _brute(rows, fields):
    one = {}
    for r in rows:
        if r[0] is not None:
            one[r[0]] = r
    occ, df = Counter(), Counter()
    for r in one.values():
        for i, f in enumerate(fields):
            if r[i + 1] is not None:
                c = Counter(t.tokens(r[i + 1]))
                for w, n in c.items():
                    occ[f, w] += n
                    df[f, w] += 1
    return {(f, w, occ[f, w], df[f, w]) for f, w in occ}


def _rows(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "Ünï", "x.y", "a-b", " nb sp", "it's"]
    rows = [(r.randrange(1 << 18), *(None if r.random() < 0.1 else " ".join(r.choices(words, weights=[1] * 40 + [30] * 7, k=r.randint(0, 30))) for _ in range(2))) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("gather", [50, 3_000_000])
def test_against_counting(spark, monkeypatch, gather):
    monkeypatch.setattr(t, "GATHER", gather)
    rows = _rows(500, 1) + [(None, "lost", "lost")]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)
    got = {(r.field_name, r.term, r.n_occurrences, r.n_records) for r in t.term_frequencies(df, "id", ["a", "b"]).collect()}
    assert got == _brute(rows, ["a", "b"])


def test_marks(spark):
    rows = [(i, "common " + ("mid " if i < 4 else "") + ("often " * 300)) for i in range(10)] + [(99, None), (7, "common often")]
    got = {r.term: r for r in t.term_frequencies(spark.createDataFrame(rows[:11], "id int, a string"), "id", ["a"]).collect()}
    assert (got["common"].freq_mark, got["mid"].freq_mark, got["often"].n_occurrences, got["often"].n_records) == ("common", None, 3000, 10)
    few = {r.term: r.freq_mark for r in t.term_frequencies(spark.createDataFrame([(1, "x")], "id int, a string"), "id", ["a"]).collect()}
    assert few == {"x": "rare"}


def test_sets_round_trip():
    for n in (0, 1, 5, 3000, 1 << t.BLOCK_BITS):
        s = np.sort(np.random.default_rng(n).choice(1 << t.BLOCK_BITS, n, replace=False)).astype(np.uint16)
        assert (t.unpacked_set(t.packed_set(s)) == s).all()


def test_dense_blocks(spark):
    df = spark.range(0, 70_000).selectExpr("id", "'every' as a")
    r = t.term_frequencies(df, "id", ["a"]).collect()
    assert [(x.term, x.n_records, x.n_occurrences) for x in r] == [("every", 70_000, 70_000)]


def test_empty(spark):
    assert t.term_frequencies(spark.createDataFrame([], "id long, a string"), "id", ["a"]).count() == 0
    assert t.term_frequencies(spark.createDataFrame([(1, None), (2, ""), (3, "...")], "id long, a string"), "id", ["a"]).count() == 0
