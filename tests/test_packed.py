import random

import numpy as np
import pytest

from monthloom.operators import packed as p

TYPES = ["Center", "Tower", "TRACON", "FSS", "Ground", "CTAF", "Military Facility", "Ramp", "UNICOM"]
PLAIN = ["Old Mill", "O'Dorrel", "131.45", "Night Rules", "Tarn's Edge"]
QUOTED = ["Old | New", "Field, The", "Gate 4/5", 'The "Old" Strip; East', 'Tarn\'s "Low" Edge, South']


def _made(n, seed):
    """Advisory and member strings with the values they hold."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        entries = [(r.choice(TYPES), *((r.choice(QUOTED), "") if r.random() < 0.2 else (r.choice(PLAIN), "") if r.random() < 0.2 else ("".join(r.choices("JQVXZ", k=3)), r.choice(["", ".Tower", ".ARTCC"])))) for _ in range(r.randint(1, 5))]
        texts, members = [], []
        for t, name, suffix in entries:
            if name in QUOTED:
                q = '"' + name.replace('"', '""') + '"'
                texts.append(r.choice([f"{t} {q}", '"' + f"{t} {name}".replace('"', '""') + '"']))
            else:
                texts.append(f"{t} {name}{suffix}")
            members.append(f"({t!r}, {name!r}, {suffix!r})")
        text = texts[0] + "".join(r.choice(["; ", ", ", " / ", " & ", "|", "\n", "\t", ";;"]) + t for t in texts[1:])
        style = r.random()
        first = "[" + ", ".join(members) + "]" if style < 0.5 else ";".join(f'{t},"' + n.replace('"', '""') + f'",{s}' if n in QUOTED else f"{t},{n},{s}" for t, n, s in entries)
        rows.append((i, text + r.choice(["", "; ", " "]), first, [f"{t} {n}{s}" for t, n, s in entries], [" ".join(x for x in e if x) for e in entries]))
    return rows


def test_values_of_a_column(spark):
    rows = _made(400, 1)
    df = spark.createDataFrame([r[:3] for r in rows], "id int, a string, f string")
    for col, arity, k in (("a", None, 3), ("f", 3, 4)):
        got = {}
        for r in p.split_values(df, "id", col, arity).collect():
            got.setdefault(r.id, {})[r.pos] = r.item
        wrong = [(r[1 if k == 3 else 2], got.get(r[0])) for r in rows if [got[r[0]][i + 1] for i in range(len(got[r[0]]))] != r[k]]
        assert wrong == []


def _split(spark, rows, arity=None):
    got = {}
    for r in p.split_values(spark.createDataFrame(rows, "id int, a string"), "id", "a", arity).collect():
        got.setdefault(r.id, {})[r.pos] = r.item
    return {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()}


def test_a_mark_inside_names_does_not_part(spark):
    rows = [(i, "Tower Gate 4/5; Center A1, Ramp B2") for i in range(30)] + [(100 + i, f"Tower Gate 4/5, Center N{i}; Ramp M{i}") for i in range(30)]
    got = _split(spark, rows)
    assert all(got[i] == ["Tower Gate 4/5", "Center A1", "Ramp B2"] for i in range(30))
    assert all(got[100 + i] == ["Tower Gate 4/5", f"Center N{i}", f"Ramp M{i}"] for i in range(30))


def _six(seed, name):
    """Texts of which a tenth hold a name of six pieces, with their values; name takes a type."""
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(300):
        values = [f"{r.choice(TYPES)} {''.join(r.choices('JQVXZ', k=3))}" for _ in range(r.randint(1, 4))]
        if r.random() < 0.1:
            values.insert(r.randint(0, len(values)), name(r.choice(TYPES)))
        rows.append((i, r.choice(["; ", ", ", " & "]).join(values)))
        want[i] = values
    return rows, want


def test_a_value_of_six_pieces(spark):
    rows, want = _six(5, lambda t: "Ramp Pads 1/2 / 3/4/5/6")
    assert _split(spark, rows) == want


@pytest.mark.xfail(reason="a long tail that recurs behind nine types is cut: its parts are seen more often than each whole value", strict=True)
def test_a_value_of_six_pieces_behind_many_types(spark):
    rows, want = _six(5, lambda t: f"{t} Pads 1/2 / 3/4/5/6")
    assert _split(spark, rows) == want


def test_pairs_that_stand_together_stay_two_values(spark):
    rows = [(i, "Tower AAA; Center BBB") for i in range(200)] + [(1000 + i, f"Tower X{i}") for i in range(30)] + [(2000 + i, f"Center Y{i}; Ramp Z{i}") for i in range(30)]
    assert all(v == ["Tower AAA", "Center BBB"] for k, v in _split(spark, rows).items() if k < 1000)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " ; ;"), (4, 'Tower "open'), (5, "Tower A;Tower A"), (5, "Tower A;Tower A"), (6, "Tower " + "x" * 30_000)]
    got = p.split_values(spark.createDataFrame([(*r, 7) for r in rows], "id int, a string, pos int"), "id", "a").collect()
    assert sorted({r.id for r in got}) == [4, 5, 6]
    assert sum(r.id == 5 for r in got) == 4
    assert p.split_values(spark.createDataFrame([], "id int, a string"), "id", "a").count() == 0


def test_pieces_and_members():
    assert p.pieces("a; 'b;c' ,\"d\"\"e\"") == (["a", " b;c ", 'd"e'], ["", ";", ","])
    assert p.members('[["T", "a\\"b", ""], ["U", "x", null]]') == (["T", 'a"b', "", "U", "x", ""], ["", ",", ",", "),(", ",", ","])
    assert p.members("[]")[0] == [""] and p.members("T,a,")[0] == ["T", "a", ""] and p.members("")[0] == []
    assert p.members("(A,b,)\n(,c,d)") == (["A", "b", "", "", "c", "d"], ["", ",", ",", ")\n(", ",", ","])
    assert p.pieces(" 'a" * 50_000)[0] == [" 'a" * 50_000]


def test_bare_values_beside_groups_and_open_brackets(spark):
    rows = [(i, f"Tower,A{i},x") for i in range(40)] + [(100, "(Tower, A1, x); Center,B,y | [Ramp, C, z]"), (101, "[Center,B,y, (Tower, A1, x)]"), (102, "(Tower,A1,x;Center,B,y"), (103, "Tower,Field (North),x"), (104, "[('Tower', 'A1', None), ('Ramp', 'C', 'z')]")]
    got = {}
    for r in p.split_values(spark.createDataFrame(rows, "id int, f string"), "id", "f", 3).collect():
        got.setdefault(r.id, {})[r.pos] = r.item
    values = {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()}
    assert values[100] == ["Tower A1 x", "Center B y", "Ramp C z"]
    assert values[101] == ["Center B y", "Tower A1 x"]
    assert values[102] == ["Tower A1 x", "Center B y"]
    assert values[103] == ["Tower Field (North) x"]
    assert values[104] == ["Tower A1", "Ramp C z"]


def test_bracketed_values_are_learnt_from(spark):
    m = p.learnt(p.cut(spark.createDataFrame([(1, "[('Tower', 'A', 'x')]")] * 3, "id int, f string"), "id", "f", 3), 3)
    assert np.isfinite(m.whole(np.array([p.value_print(["Tower", "A", "x"])]), 3)).all()


def test_one_member_missing(spark):
    rows = [(i, f"Tower,A{i},x;Center,B{i},;Ramp,C{i},y") for i in range(60)] + [(100, "Tower,A7;Center,B,"), (101, "('Ramp', 'C', 'y'), ('Tower', 'A9')")]
    got = _split(spark, rows, 3)
    assert got[5] == ["Tower A5 x", "Center B5", "Ramp C5 y"]
    assert got[100] == ["Tower A7", "Center B"] and got[101] == ["Ramp C y", "Tower A9"]


def test_cutting_without_quotes_is_the_same(spark):
    r = random.Random(7)
    texts = ["".join(r.choices("ab .;,&|/\n\té", k=r.randint(0, 20))) for _ in range(3000)]
    got = {x.id: (x.parts, x.marks) for x in p.cut(spark.createDataFrame(list(enumerate(texts)), "id int, a string"), "id", "a").collect()}
    for i, t in enumerate(texts):
        both = [(a, m) for a, m in zip(*p.pieces(t)) if a.strip()]
        assert got.get(i, ([], [])) == ([a for a, _ in both], [m for _, m in both])


def test_lattice_against_all_paths():
    """Posteriors and the best path of a short text, by listing every way to cut it."""
    from itertools import product

    import pyarrow as pa

    m = p.Model(None, {"a": -1.0, "b": -2.0}, {"a": -2.0, "b": -0.5}, -3.0, -2.5, lengths=np.linspace(-1, -4, p.MOST_WORDS), marks={";": (-0.1, -2.4), "/": (-1.2, -0.4)}, values={2: (np.array([p.value_print(["b", "c d"])]), np.array([-1.7]))}, begun={"b": -1.0})
    parts, marks = ["a", "b", "c d", "a b"], ["", "/", ";", "/"]
    batch = p.Batch(m, np.array([4]), pa.array(parts), pa.array(marks))
    lat = p.Lattice(batch, next(batch.groups()))
    scores = {}
    for way in product([True, False], repeat=3):
        begins = [0] + [i + 1 for i, x in enumerate(way) if x]
        total = 0.0
        for i, e in zip(begins, [*begins[1:], 4]):
            ws = [w for q in parts[i:e] for w in q.split()]
            spelt = sum(m.inner.get(w, -2.5) for w in ws[1:]) + m.lengths[len(ws)]
            whole = -0.7 if parts[i:e] == ["b", "c d"] else -np.inf
            total += m.heads.get(ws[0], -3.0) + np.logaddexp(spelt, whole) + np.log(0.5) + sum(m.marks[x][1] for x in marks[i + 1 : e]) + (m.marks[marks[i]][0] if i else 0)
        scores[tuple([True, *way])] = total
    assert tuple(lat.best()[0].tolist()) == max(scores, key=scores.get)
    norm = np.logaddexp.reduce(list(scores.values()))
    begins = np.zeros(4)
    for _, post in lat.expected():
        begins[: post.shape[1]] += post[0]
    want = [sum(np.exp(s - norm) for w, s in scores.items() if w[i]) for i in range(4)]
    assert np.allclose(begins, want)
