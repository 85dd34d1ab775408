import random
from collections import Counter

import pytest

from monthloom.llm import packing as k


def test_fullest_against_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        lengths = [r.randint(1, 30) for _ in range(r.randint(0, 10))]
        room = r.randint(0, 80)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        got = k.fullest(Counter(lengths), room)
        assert sum(a * n for a, n in got.items()) == max(sums)
        assert not got - Counter(lengths)


def test_packed_uses_every_item_once():
    r = random.Random(2)
    hist = Counter(r.randint(1, 45) for _ in range(3000))  # no two items that can't share, so the sum is the bound
    plan = k.packed(hist, 100)
    used = Counter()
    for times, use in plan:
        assert sum(a * n for a, n in use.items()) <= 100
        for a, n in use.items():
            used[a] += n * times
    assert used == hist
    assert sum(t for t, _ in plan) <= -(-sum(a * n for a, n in hist.items()) // 100) + 1


@pytest.mark.parametrize("group", [500_000, 7])
def test_fill(spark, monkeypatch, group):
    monkeypatch.setattr(k, "GROUP", group)
    r = random.Random(3)
    sizes = [(i, r.choice([0, 1, 5, 5, 5, 40, 99, 100, 101, 250, 300])) for i in range(400)] + [(1000, None), (7, 3)]
    df = spark.createDataFrame([(*s, 9, "x") for s in sizes], "id long, n int, piece_ int, first_ string")
    rows = k.fill(df, "id", "n", 100).collect()
    used, whole = Counter(), Counter()
    for x in rows:
        used[x.container_id] += x.n
        whole[x.id] += x.n
        assert x.n == 100 or x.piece == max(0, x.first // 100)
    assert max(used.values()) <= 100
    want = Counter()
    for i, n in sizes:
        want[i] += n or 0
    assert whole == Counter({i: n for i, n in want.items() if i != 1000})
    full = {x.container_id for x in rows if x.n > 0}
    assert full == set(range(len(full)))
    assert len(full) - sum(n or 0 for _, n in sizes) / 100 < 2
    divided = {i for i, n in sizes if n and n > 100}
    assert {x.id for x in rows if x.piece > 0} == divided


def test_empty_and_bad(spark):
    assert k.fill(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0
    assert [(x.container_id, x.n) for x in k.fill(spark.createDataFrame([(1, 0)], "id long, n int"), "id", "n").collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        k.fill(spark.createDataFrame([(1, 0)], "id long, n int"), "id", "n", 0)


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", "Hello world, it's 12345!", "Größe — 東京 \n\n x", "<|endoftext|>", "a" * 5000, "The  quick   brown"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(99, None)], "id int, text string")
    got = {r.id: r.n_tokens for r in k.token_counts(df, "id", "text").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
