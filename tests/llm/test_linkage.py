import random

import numpy as np

from monthloom.llm import linkage as k

SCHEMA = "id long, day int, loc string, state string, lat double, lon double, tail string, make string, model string, phase string, persons int, office string"


def _made(n, seed):
    """Two tables that share the first n things, noisily, with things of their own and decoys of the same tail or the same place and day."""
    r = random.Random(seed)
    places = [("".join(r.choices("JQVXZ", k=3)), f"S{i % 12}", r.uniform(25, 45), r.uniform(-120, -70)) for i in range(60)]

    def thing():
        p = places[0] if r.random() < 0.3 else r.choice(places)
        return [r.randrange(3000), *p, "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=7)), r.choice("abcdefgh"), r.choice(["1", "2", "3", "4", "5"]), r.choice(["climb", "taxi", "landing", "cruise", "descent"]), r.randint(1, 60), f"FO{r.randint(0, 7)}{r.randint(0, 2)}"]

    def noisy(t):
        t = list(t)
        if r.random() < 0.15:
            t[0] += r.choice([-1, 1])
        if r.random() < 0.1:
            t[1] = None
        x = r.random()
        if x < 0.1:
            t[5] = t[5][:5] + "**"
        elif x < 0.2:
            t[5] = None
        elif x < 0.25:
            t[5] = t[5][:2] + t[5][3] + t[5][2] + t[5][4:]
        if r.random() < 0.1:
            t[7] = None
        if r.random() < 0.08:
            t[9] = r.randint(1, 60)
        return t

    both = [thing() for _ in range(n)]
    a, b = [*both], [noisy(t) for t in both]
    a += [thing() for _ in range(n)]
    b += [thing() for _ in range(n)]
    for t in both[: n // 5]:  # decoys
        d = thing()
        d[5] = t[5]
        b.append(d)
        e = thing()
        e[:5] = t[:5]
        b.append(e)
    return [(i, *t) for i, t in enumerate(a)], [(10_000 + i, *t) for i, t in enumerate(b)]


def test_links(spark):
    a, b = _made(400, 1)
    got = k.linked(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    pairs = {(r.a_id, r.b_id) for r in got}
    right = sum(y == x + 10_000 and x < 400 for x, y in pairs)
    assert right / 400 > 0.95 and right / len(pairs) > 0.97
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    assert all(k.LEAST <= r.confidence <= 1 for r in got)


def test_each_candidate_once_and_blocking_loses_little(spark):
    a, b = _made(200, 2)
    rows = k.candidates(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    keys = [(r.a_id, r.b_id) for r in rows]
    assert len(keys) == len(set(keys))
    assert sum((i, 10_000 + i) in set(keys) for i in range(200)) / 200 > 0.97
    assert len(keys) < 0.05 * len(a) * len(b)


def test_estimates_recover_the_truth():
    r = np.random.default_rng(4)
    truth = r.random(20_000) < 0.3
    pat = np.stack([np.where(truth, r.random(20_000) < 0.9, r.random(20_000) < p) for p in (0.05, 0.2, 0.1)], 1).astype(int)
    pat[r.random(20_000) < 0.1, 0] = -1
    blocked = pat[(pat == 1).sum(1) >= 2]
    u, n = np.unique(blocked, axis=0, return_counts=True)
    apart = pat[(pat == 1).sum(1) < 2]
    for draws in (len(apart), 1_000):
        v, o = np.unique(apart[:draws], axis=0, return_counts=True)
        _, share, m, non = k.estimated(u, n.astype(float), [1, 1, 1], (v, o.astype(float)), 20_000)
        # of matches those are meant that blocking reaches
        reached = pat[truth & ((pat == 1).sum(1) >= 2)]
        assert abs(share - len(reached) / 20_000) < 0.03
        assert all(abs(x[1] - (c == 1).sum() / (c >= 0).sum()) < 0.04 for x, c in zip(m, reached.T))
        assert all(abs(x[1] - p) < 0.04 for x, p in zip(non, (0.05, 0.2, 0.1)))


def test_hot_blocks_are_split_without_loss(spark, monkeypatch):
    a, b = _made(150, 3)
    a = [(*r[:1], 77, "JQX", *r[3:7], "a", "1", "taxi", 5, r[11]) if r[0] % 2 else r for r in a]  # half the records of both in one block
    b = [(*r[:1], 77, "JQX", *r[3:7], "a", "1", "taxi", 5, r[11]) if r[0] % 3 else r for r in b]
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    whole = {tuple(r) for r in k.candidates(x, y).collect()}
    monkeypatch.setattr(k, "HOT", 7)
    assert {tuple(r) for r in k.candidates(x, y).collect()} == whole and len(whole) > 10_000


def test_nulls_and_empty(spark):
    none = (1, *[None] * 11)
    a, e = spark.createDataFrame([none], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert k.linked(a, a).count() == k.linked(a, e).count() == k.linked(e, a).count() == 0


PAIR = "a_id long, b_id long, confidence double, gap int"


def test_all_of_a_block_of_equals_are_linked(spark):
    pairs = spark.createDataFrame([(x, 100 + y, 0.9, 0) for x in range(12) for y in range(12)], PAIR)
    for finish in (0, k.FINISH):
        got = k.one_to_one(pairs, finish).collect()
        assert len(got) == len({r.a_id for r in got}) == len({r.b_id for r in got}) == 12


def test_long_chains_of_best_partners(spark):
    steps = range(20)  # each pair shares a record with the next, which is better
    pairs = spark.createDataFrame([((i + 1) // 2, 100 + i // 2, 0.76 + i / 100, 0) for i in steps], PAIR)
    want = {((i + 1) // 2, 100 + i // 2) for i in steps if i % 2}
    for finish in (0, 7, k.FINISH):
        assert {(r.a_id, r.b_id) for r in k.one_to_one(pairs, finish).collect()} == want


def test_rounds_and_driver_agree(spark):
    r = random.Random(5)
    rows = {(r.randrange(40), 100 + r.randrange(40)): (r.choice([0.8, 0.9]), r.randrange(2)) for _ in range(200)}
    pairs = spark.createDataFrame([(*p, *v) for p, v in rows.items()], PAIR)
    assert k.one_to_one(pairs, 0).exceptAll(k.one_to_one(pairs)).count() == k.one_to_one(pairs).exceptAll(k.one_to_one(pairs, 0)).count() == 0
