import random

import numpy as np
import pytest

from monthloom.llm import leakage as k

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "sk", "th", "lm")]


def _tables(seed, n_docs=120):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(WORDS[:150], k=r.randint(10, 70)))) for i in range(1, 25)]
    docs = []
    for d in range(n_docs):
        own = r.choices(WORDS, k=r.randint(5, 120))
        if r.random() < 0.6:
            words = r.choice(items)[1].split()
            length = min(len(words), r.randint(15, 45))
            at = r.randint(0, len(words) - length)
            part = [w if r.random() > r.choice([0, 0.05, 0.12]) else r.choice(["zzz", *WORDS[:9]]) for w in words[at : at + length]]
            if r.random() < 0.2:
                part.insert(len(part) // 2, "between")
            part = [w.upper() if r.random() < 0.2 else w + r.choice(["", "", ",", "!"]) for w in part]
            text = r.choice([" ", "\n", "  "]).join(part)
            if r.random() < 0.3:
                text = text.replace("a", "а").replace("n", "ｎ")
            own[len(own) // 2 : len(own) // 2] = text.split(" ")
        docs.append((1000 + d, " ".join(own)))
    return items, [*docs, (1, None), (2, ""), (3, items[5][1][:40])]


@pytest.mark.parametrize("seed,block,scanned", [(1, 2000, 20_000), (2, 7, 20_000), (3, 4, 9)])
def test_against_brute_force(spark, monkeypatch, seed, block, scanned):
    monkeypatch.setattr(k, "MOST_ITEMS", block)
    monkeypatch.setattr(k, "SCANNED", scanned)
    items, docs = _tables(seed)
    want = k.brute_force(docs, items)
    assert len(want) > 20
    df = spark.createDataFrame([(*d, 0) for d in docs + docs[:5]], "doc_id long, text string, item_id int")
    got = {(r.item_id, r.doc_id) for r in k.leaked(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert got == want


def _slow(doc, item):
    for i in range(len(doc)):
        for j in range(len(item)):
            for n in range(20, min(len(doc) - i, len(item) - j) + 1):
                if 10 * sum(doc[i + x] == item[j + x] >= 0 for x in range(n)) >= 9 * n:
                    return True
    return False


def test_leak_definition():
    r = np.random.default_rng(3)
    seen = set()
    for _ in range(60):
        item = r.integers(0, 50, r.integers(18, 46))
        doc = np.concatenate([r.integers(-1, 50, r.integers(0, 8)), np.where(r.random(len(item)) < r.choice([0.0, 0.08, 0.12]), -1, item)[r.integers(0, 3) :], r.integers(-1, 50, r.integers(0, 8))])
        got = k.leaks(doc, item)
        assert got == _slow(doc.tolist(), item.tolist())
        seen.add(got)
    assert seen == {True, False}


def test_common_subsequence():
    def slow(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return p[-1]

    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 6, r.integers(1, 30)), r.integers(0, 6, r.integers(0, 30))
        assert k.common_subsequence(a, b) == slow(a.tolist(), b.tolist())


def test_latent_space_keeps_neighbours(spark):
    """With a rank far below the vocabulary, of 200 passages with a tenth of their words changed nine in ten are nearest to their own."""
    r = np.random.default_rng(5)
    n = 400
    own = r.integers(0, n, (200, k.WINDOW))
    idf = np.ones(n)
    spans = spark.createDataFrame([(p.tolist(),) for p in own], "words array<int>")
    basis = k.latent_basis(spans, idf, own)
    assert basis.shape == (n, k.RANK)
    changed = np.where(r.random(own.shape) < 0.1, -1, own)
    near = (k.weighted(changed, idf, basis) @ k.weighted(own, idf, basis).T).argmax(1)
    assert (near == np.arange(200)).mean() >= 0.9


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "w " * 30)], "item_id long, text string")
    assert k.leaked(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert k.leaked(spark.createDataFrame([(1, "x")], docs.schema), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_the_sketch_sums_every_passage(spark):
    r = np.random.default_rng(11)
    items = k.Items([1], [np.arange(30, dtype=np.int32)], {str(i): i for i in range(30)})
    own, _ = items.passages()
    assert [p[0] for p in own] == list(range(11))
    words = [r.integers(0, 30, n).tolist() for n in (20, 27, 61)]
    idf, q = r.random(30) + 0.5, r.standard_normal((30, 4))
    rows = np.concatenate([k._windows(np.array(w, np.int32))[0] for w in words] + [own])
    a = np.zeros((len(rows), 30))
    for i, p in enumerate(rows):
        np.add.at(a[i], p[p >= 0], idf[p[p >= 0]])
        a[i] /= np.sqrt((idf[p[p >= 0]] ** 2).sum())
    df = spark.createDataFrame([(w,) for w in words], "words array<int>")
    assert np.allclose(k._sketch(df, idf, q, own), a.T @ (a @ q))


def test_keys_of_any_type(spark):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([("d-1", "so " + item + " it went"), (None, item), ("d-2", "other words")], "doc string, text string")
    items = spark.createDataFrame([("i/1", item), (None, item), ("i/2", "short")], "item string, text string")
    assert [tuple(r) for r in k.leaked(docs, "doc", "text", items, "item", "text").collect()] == [("i/1", "d-1")]


@pytest.mark.parametrize("seed,n", [(1, 500), (2, 5_000), (3, 20_000)])
def test_index_recall(seed, n):
    """Vectors near those asked for, of the cosine that changed words leave, are found as a full comparison finds them."""
    r = np.random.default_rng(seed)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = unit(r.standard_normal((n, 96)) @ np.diag(np.linspace(2, 0.2, 96)))
    asked = unit(vectors[r.integers(0, n, 500)] + 0.5 * unit(r.standard_normal((500, 96))))
    want = set(zip(*(x.tolist() for x in np.nonzero(asked @ vectors.T >= k.COSINE))))
    got = set(zip(*(x.tolist() for x in k.Index.of(vectors).near(asked, k.COSINE))))
    assert got <= want and len(got) >= 0.9 * len(want) > 400
