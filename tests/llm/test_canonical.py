import random

import pytest

from monthloom.llm import canonical as c

ENTRIES = [
    ("XNV", "brouphford regional airport", "port renstead", "TX", "Texas", "KXNV"), ("QAX", "hoaldmere municipal airport", "hoaldmere", "TX", "Texas", "KQAX"), ("VKZ", "hoaldmere air park", "hoaldmere", "TX", "Texas", "KVKZ"),
    ("JUZ", "mount nilbwick memorial airport", "mount nilbwick", "AK", "Alaska", "KJUZ"), ("AAA", "twinley field", "twinley", "NM", "New Mexico", "KAAA"), ("BBB", "twinley field", "twinley", "PR", "Puerto Rico", "KBBB"), ("QQJ", "cromaenova municipal airport", "cromaenova", "ME", "Maine", "KQQJ"),
]
CASES = [
    (("brouphford rgnl arpt", "port renstead", "TX"), "XNV"), (("broufford reg'l", None, None), "XNV"), (("rwy 19 brouphford reg apt", None, "texas"), "XNV"), (("b r o u p h f o r d regional", None, None), "XNV"), (("brouphfordregionalairport", None, None), "XNV"),
    (("apt brouphford regional", "pt renstead", None), "XNV"), (("brouphfo", "port renstead", "TX"), "XNV"), (("kxnv", None, None), "XNV"), (("qzz", "port renstead", "TX"), None), ((None, "port renstead", "TX"), "XNV"), (("n/a", "port rensteda", "TX"), "XNV"),
    (("brouphford regional airport, port renstead tx", None, None), "XNV"), (("brouphford airstrip", "port renstead", "TX"), None), (("farm field", "port renstead", "TX"), None), (("off airport", "port renstead", "TX"), None), (("hoaldmere", "hoaldmere", "TX"), None), (("hoaldmere air pk", "wrong", "AK"), "VKZ"), (("hoaldmere, air park.", None, None), "VKZ"),
    (("hoaldmere intl", "hoaldmere", "TX"), None), (("mt. nilbwick meml", None, None), "JUZ"), (("mt nlbwck mm pt", None, "AK"), "JUZ"), (("nilbwick mem airport mt.", None, None), "JUZ"), (("twinley field", None, None), None), (("twinley fld", None, "P.R."), "BBB"), (("twinley field", "twinley nm", None), "AAA"),
    (("cromaenova", "cromaenova municipal airport", "ME"), "QQJ"), (("crmnv mncpl pt", "cromaeoav", "ME"), "QQJ"), (("", "", ""), None), ((None, None, "TX"), None), (("x" * 20_000, "y" * 20_000, "TX"), None),
]


def _slow(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def test_distance_and_tree():
    r = random.Random(1)
    words = list({"".join(r.choices("abcd", k=r.randint(0, 9))) for _ in range(400)})
    tree = c.BKTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    for _ in range(60):
        q = "".join(r.choices("abcd", k=r.randint(0, 9)))
        assert all(c.edit_distance(q, w) == _slow(q, w) for w in words[:60])
        assert {(d, f) for d, f, _ in tree.within(q, 3)} == {(_slow(q, w), w) for w in words if _slow(q, w) <= 3}
    asked = ["".join(r.choices("abcdé", k=r.randint(0, 12))) for _ in range(300)] + ["a" * 64, "b" * 70]
    most = [r.randint(0, 4) for _ in asked]
    got = {(q, d, f) for q, d, f, _ in tree.within_many(asked, most)} | {(300 + q, d, f) for q, d, f, _ in tree.within_many(asked[300:], most[300:])}
    assert got == {(q, d, w) for q, f in enumerate(asked) for w in words if (d := _slow(f, w)) <= most[q]}


def _frames(spark):
    ref = spark.createDataFrame(ENTRIES, "id string, name string, city string, state string, full_state string, icao string").selectExpr("*", "id as loc")
    rows = [(i, *t, "mine") for i, (t, _) in enumerate(CASES)] * 2
    return ref, spark.createDataFrame(rows, "id int, n string, c string, s string, entry_id string")


@pytest.mark.parametrize("shard", [50_000, 3])
def test_typed(spark, monkeypatch, shard):
    monkeypatch.setattr(c, "SHARD", shard)
    monkeypatch.setattr(c, "QUERIES", 40)
    ref, df = _frames(spark)
    got = c.map_to_entries(df, "n", "c", "s", ref, ["loc", "icao"], keep=["id"]).collect()
    assert len(got) == 2 * len(CASES)
    wrong = [(CASES[r.id], r.entry_id) for r in got if r.entry_id != CASES[r.id][1]]
    assert wrong == []


def test_one_tree_and_shards_agree(spark, monkeypatch):
    """Random lists with names near each other, a code that is also a name, and states known from other entries only."""
    r = random.Random(4)
    name = lambda: "".join(r.choices(["wyn", "har", "ton", "ley", "mor", "dale"], k=r.randint(2, 4)))
    states = {"TX": "Texas", "NM": "New Mexico", "ME": "Maine"}
    entries = [("WYN", "harland field", "harland", "TX", "Texas", "KWYN"), ("HRL", "wyn field", "wynton", "TX", "Texas", "KHRL")]
    for i in range(60):
        st = r.choice(list(states))
        entries.append((f"E{i}", f"{name()} {r.choice(['field', 'municipal airport', 'airport'])}", name(), st, states[st] if i % 7 == 0 else None, f"KE{i}"))
    ref = spark.createDataFrame(entries, "id string, name string, city string, state string, full_state string, icao string").selectExpr("*", "id as loc")
    noisy = lambda t: t if r.random() < 0.4 else "".join(x for x in t if r.random() > 0.12)
    typed = [("wyn", "wynton", "TX")] + [(noisy(e[1]), noisy(e[2]) + r.choice(["", " new mexico", " tx"]), r.choice([e[3], None, "maine"])) for e in r.choices(entries, k=250)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(typed)], "id int, n string, c string, s string")
    answers = []
    for shard, queries in ((50_000, 100_000), (40, 50), (7, 1_000)):
        monkeypatch.setattr(c, "SHARD", shard)
        monkeypatch.setattr(c, "QUERIES", queries)
        answers.append({x.id: x.entry_id for x in c.map_to_entries(df, "n", "c", "s", ref, ["loc", "icao"], keep=["id"]).collect()})
    assert answers[0] == answers[1] == answers[2]
    assert answers[0][0] == "WYN" and sum(v is not None for v in answers[0].values()) > 100


def test_many_rows_of_one_triple(spark, monkeypatch):
    from monthloom import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    ref, _ = _frames(spark)
    df = spark.range(20_000).selectExpr("id", "'brouphford rgnl' as n", "cast(null as string) as c", "'TX' as s")
    got = c.map_to_entries(df, "n", "c", "s", ref, ["loc"], keep=["id"]).groupBy("entry_id").count().collect()
    assert [(x.entry_id, x["count"]) for x in got] == [("XNV", 20_000)]


def test_empty(spark):
    ref, df = _frames(spark)
    assert c.map_to_entries(df.limit(0), "n", "c", "s", ref).count() == 0
    assert {r.entry_id for r in c.map_to_entries(df, "n", "c", "s", ref.limit(0)).collect()} == {None}


@pytest.mark.parametrize("shard", [50_000, 3])
def test_closest(spark, monkeypatch, shard):
    monkeypatch.setattr(c, "SHARD", shard)
    cities = ["Springfield", "Shelbyville", "Ogdenville", "Brockway", "Capital City", "Spring"]
    typed = ["springfeild", "Ogdenvile", "zzz", "Brockway", None, ""]
    got = {(r.value, r.form, r.distance) for r in c.closest(spark.createDataFrame([(x,) for x in typed], "v string"), "v", spark.createDataFrame([(x,) for x in cities], "f string"), "f").collect()}
    want = {(v, f, _slow(v.lower(), f.lower())) for v in typed if v is not None for f in cities if _slow(v.lower(), f.lower()) <= c.reach(len(v))}
    assert {g for g in got if g[1]} == want and {g[0] for g in got if not g[1]} == {"zzz", ""}
