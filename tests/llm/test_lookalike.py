import random
import unicodedata

import pyarrow as pa
import pytest

from monthloom.llm import lookalike as L


def one(text):
    return L.one_form(pa.array([text])).to_pylist()[0]


@pytest.mark.parametrize("a,b", [("Ｆｕｌｌ　１２３", "Full 123"), ("café", "café"), ("a​b⁠﻿", "ab"), ("a b c", "a b c"), ("САR", "CAR"), ("ﬃx", "ffix"), ("KÅ", "KÅ"), ("so­ft", "soft"), ("οut", "out"), ("q̣̇", "q̣̇"), ("x‑y", "x-y")])
def test_same_look(a, b):
    assert one(a) == one(b)


@pytest.mark.parametrize("a,b", [("Car", "car"), ("café", "cafe"), ("x²", "x2"), ("a b", "a  b"), ("a\nb", "a b"), ("one", "two"), ("①", "1")])
def test_visible_difference(a, b):
    assert one(a) != one(b)


def test_composition_against_the_standard():
    rnd = random.Random(5)
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x345), 0x1EB1, 0x1ED9, 0x1E9B]]
    xs = ["".join(rnd.choices(chars, k=rnd.randint(0, 12))) for _ in range(5000)]
    n, begin, flat, _ = L.tables()
    want = [unicodedata.normalize("NFC", "".join(chr(x) for c in t for x in flat[begin[ord(c)] : begin[ord(c)] + n[ord(c)]])) for t in xs]
    assert L.one_form(pa.array(xs)).to_pylist() == want


def test_twice_is_once():
    xs = ["Ｆｕｌｌ", "ẹ́", "́alone", "", None, "plain", "😀‍😀", "x" * 300_000 + "é"]
    first = L.one_form(pa.array(xs))
    assert L.one_form(first).to_pylist() == first.to_pylist()
    assert first.to_pylist()[3:6] == ["", None, "plain"]


def test_pairs_and_classes(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, None), (6, ""), (7, ""), (8, "​"), (9, "same"), (10, "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, text string, look string")
    assert {tuple(r) for r in L.look_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (6, 8), (7, 8)}
    assert {tuple(r) for r in L.look_classes(df, "id", "text").collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (6, 6, 2), (7, 6, 2), (8, 6, 2)}


def test_pairs_against_all_pairs(spark):
    rnd = random.Random(2)
    parts = ["a", "а", "é", "é", "Ａ", "A", " ", " "]
    rows = [(i, "".join(rnd.choices(parts, k=2))) for i in range(120)]
    form = dict(zip(range(120), L.one_form(pa.array([t for _, t in rows])).to_pylist()))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a != b and form[i] == form[j]}
    assert {tuple(r) for r in L.look_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()} == want


def test_empty(spark):
    assert L.look_pairs(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@pytest.mark.parametrize("a,b", [("\u13aa\ua4d3\u13df", "ADC"), ("z\u2c9f\u2c9f", "zoo"), ("\u03c1art", "part"), ("\u0131n", "in"), ("s\u0456de", "side"), ("\u03ca", "\u00ef")])
def test_other_alphabets(a, b):
    assert one(a) == one(b)


def test_hangul():
    words = ["한국어", "각", "가각\u11a8", "뷁!", "한 국"]
    for w in words:
        assert one(w) == one(unicodedata.normalize("NFD", w)) == unicodedata.normalize("NFC", w)
    assert one("ㅎㅏㄴ") != one("한") and one("\u1112") == "\u1112"
    rnd = random.Random(9)
    xs = ["".join(chr(rnd.choice([rnd.randint(0x1100, 0x1112), rnd.randint(0x1161, 0x1175), rnd.randint(0x11A8, 0x11C2), rnd.randint(0xAC00, 0xD7A3), 0x41])) for _ in range(8)) for _ in range(2000)]
    assert L.one_form(pa.array(xs)).to_pylist() == [unicodedata.normalize("NFC", x) for x in xs]


def test_confusables_file(tmp_path, spark):
    f = tmp_path / "confusables.txt"
    f.write_text("# header\n05D8 ;\t0076 ;\tMA\t# tet\n0031 ;\t006C ;\tMA\n0430 ;\t0078 ;\tMA\n006D ;\t0072 006E ;\tMA\n", encoding="utf-8-sig")
    more = L.confusables(str(f))
    assert more == ((0x430, 0x78), (0x5D8, 0x76)) and L.confusables(None) == ()
    assert L.one_form(pa.array(["\u05d8an 1m", "\u0430"]), more=more).to_pylist() == ["van 1m", "a"]
    df = spark.createDataFrame([(1, "\u05d8an"), (2, "van")], "id long, text string")
    assert L.look_pairs(df, "id", "text", more).count() == 1 and L.look_pairs(df, "id", "text").count() == 0


def test_a_form_of_very_many_rows(spark):
    df = spark.range(100_003).selectExpr("id", "if(id < 100000, 'hot', 'h\u043et') as text")
    assert L.look_pairs(df, "id", "text").count() == 300_000
    assert L.look_classes(df, "id", "text").groupBy("class_id", "n_forms").count().collect()[0].asDict() == {"class_id": 0, "n_forms": 2, "count": 100_003}
