import pytest
from pyspark.sql import functions as F

from monthloom.functions import dates, names, text
from monthloom.operators import advisory, lookup, tokens


def val(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


def test_clean_tokens_keep_tabs(spark):
    assert val(spark, text.clean_tokens, "a.b  c\td\ne-f $g (H)") == ["a", "b", "c\td\ne", "f", "g", "H"]
    assert val(spark, text.spaced_tokens, " a\tb\n c ") == ["a", "b", "c"]
    assert [val(spark, text.word_count, x) for x in (None, "", "a,b")] == [0, 0, 2]
    assert val(spark, text.joined, "A", None, "B") == "a  b"


@pytest.mark.parametrize("w,want", [("(abc", "abc"), ("abc)", "abc"), ("(abc'", "abc"), ("who?", "who"), ("a/b", "a"), ("plain", None), ("a1/b", None), ("a1:", None)])
def test_cleaned_word(spark, w, want):
    assert val(spark, text.cleaned_word, w) == want


@pytest.mark.parametrize("d,want", [("03-MAR-78", (3, 3, 1978)), ("03-MAR-77", (3, 3, 2077)), ("3-XXX-99", (3, None, 1999)), ("1999", (None, None, None)), ("31-DEC-1999", (31, 12, 1999)), (None, (None, None, None))])
def test_day_month_year(spark, d, want):
    assert tuple(val(spark, lambda c, k=k: dates.day_month_year(c)[k], d) for k in ("day", "month", "year")) == want


@pytest.mark.parametrize("k,want", [("New York 2001/3", ("New York", 2001, 3)), ("x", (None, None, None)), ("A 1/2 2001/12", ("A 1/2", 2001, 12))])
def test_entity_month(spark, k, want):
    assert tuple(val(spark, lambda c, n=n: dates.entity_month(c)[n], k) for n in ("entity", "year", "month")) == want


@pytest.mark.parametrize("n,want", [("Rgnl (Old) Fld", "regional old field"), ("a-b/c x-", "a b x"), ("- lone -", "lone"), ("X IAP", "x international airport"), (None, None), ("", "")])
def test_clean_name(spark, n, want):
    assert val(spark, names.clean_name, n) == want


@pytest.mark.parametrize("c,want", [(" kxnv ", "KXNV"), ("n/a", None), ("None", None), ("NA", None), ("", None), (None, None)])
def test_clean_code(spark, c, want):
    assert val(spark, names.clean_code, c) == want


def test_places_and_coordinates(spark):
    assert [val(spark, lambda c, k=k: names.place_parts(c)[k], "Port A, TX, United States") for k in ("city", "state", "country")] == ["port a", "tx", "united states"]
    assert val(spark, lambda c: names.place_parts(c)["city"], "one") is None
    assert [val(spark, names.coordinate, x) for x in (" 31.123456 ", "x", "")] == [31.12346, None, None]
    assert [val(spark, names.short_code, x) for x in ("KXNV", "XNV", "ABCD")] == ["XNV", "XNV", "ABCD"]


ADVISORY = "Center ATL.ARTCC; Tower ZZZ; UNICOM SFO"


def test_advisories(spark):
    f = lambda t: [tuple(e) for e in val(spark, advisory.facilities, t)]
    assert f(ADVISORY) == [("Center", "ATL", ".ARTCC"), ("Tower", "ZZZ", ""), ("UNICOM", "SFO", "")]
    assert f("") == f("; ") == [] and f("CTAF Airshow Control") == [("CTAF", "Airshow", "")]
    left = lambda t: val(spark, lambda c: advisory.residue(c, advisory.facilities(c)), t)
    assert (left(ADVISORY).strip(), left("CTAF Airshow Control"), left("TRACON Tower")) == ("", " Control", "")
    assert val(spark, advisory.advisory, "a", None) == "a" and val(spark, advisory.advisory, None, "b") == "; b"


def test_expansion(spark):
    rows = [(1, "Center ATL; Tower ATL.Tower; Tower ATL; Ramp SFO"), (2, "nothing"), (3, "Center ATL; Center ATL")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("found", advisory.facilities(F.col("t")))
    assert {tuple(r) for r in advisory.per_code(df, "id", "found").collect()} == {(1, "ATL", "Center", 2), (1, "SFO", "Ramp", 1), (2, None, None, 0), (3, "ATL", "Center", 1)}
    counts = {r.id: (r.center_ident_ct, r.tower_ident_ct) for r in advisory.type_counts(df, "id", "found").collect()}
    assert counts == {1: (1, 1), 3: (1, 0)}
    listed = advisory.by_code(df, "id", "found", spark.createDataFrame([("ATL",), ("ATL",), (None,)], "c string"), "c")
    assert {r.id: (len(r.listed), len(r.others)) for r in listed.collect()} == {1: (3, 1), 2: (0, 0), 3: (2, 0)}
    assert advisory.by_code(df.limit(0), "id", "found", spark.createDataFrame([], "c string"), "c").count() == 0
    s = df.select("id", *advisory.slots(F.col("found"), "atc")).filter("id = 1").first()
    assert (s.atc_code1, s.atc_repeated1, s.atc_repeated0, s.atc_code5) == ("ATL", True, False, "")


def _vocabulary(spark, words, **lists):
    v = spark.createDataFrame([(w, 1) for w in words], "word string, ct long")
    d = spark.createDataFrame([("nasa", "apch", "approach"), ("iata", "the", "x"), ("iata", "lag", "lagos"), ("faa", "rwy", "runway"), ("hand", "gs", "glide"), ("hand2", "fms", "y")], "dict string, acronym string, fullform string")
    names_ = ["english", "stop", "city", "airport", "hand_word", "hand_abbrev"]
    flags = {n: spark.createDataFrame([(w,) for w in lists.get(n, [])], "word string") for n in names_}
    return tokens.tagged(tokens.flags(tokens.with_dictionaries(v, d, ["nasa", "faa", "casa", "iata", "hand", "hand2"]), flags))


def test_tags_by_precedence(spark):
    t = _vocabulary(spark, ["and", "walk", "york", "a1", "jfk", "hw", "zz", "apch", "the", "lag", "gs", "fms", "rwy"], stop=["and", "the"], english=["and", "walk", "york", "lag", "the", "rwy"], city=["york", "nowhere"], airport=["jfk"], hand_word=["hw"], hand_abbrev=["gs"])
    assert {r.word: (r.tag, r.abrev) for r in t.collect()} == {
        "and": ("neg_stopword", 0), "walk": ("neg_word", 0), "york": ("neg_word", 0), "a1": ("neg_nonalpha_abrev", 0), "jfk": ("neg_airport", 0), "hw": ("neg_word_hand2", 0), "zz": ("neg_nonword", 1),
        "apch": ("pos_nonword", 1), "the": ("pos_stopword", 0), "lag": ("pos_iata_only_words", 0), "gs": ("pos_handcoded_abrev", 1), "fms": ("", 0), "rwy": ("pos_word", 0),
    }
    s = tokens.tag_summary(t).collect()
    assert sum(r.ct for r in s) == 13 and abs(sum(r.share for r in s) - 1) < 1e-4


@pytest.mark.parametrize("entries", [5000, 0])
def test_expanded_both_ways(spark, monkeypatch, entries):
    monkeypatch.setattr(tokens, "MAP_ENTRIES", entries)
    df = spark.createDataFrame([(1, "apch  to rwy\n9"), (2, None), (3, ""), (1, "apch  to rwy\n9")], "id int, t string")
    table = spark.createDataFrame([("apch", "approach"), ("rwy", "runway strip")], "word string, fullform string")
    got = sorted(((r.id, r.o) for r in tokens.expanded(df, "t", table, "o").collect()), key=str)
    assert got == [(1, "approach to runway strip 9")] * 2 + [(2, None), (3, "")]


def test_counts(spark):
    df = spark.createDataFrame([("a", "x y x"), ("a", "x y x"), ("b", None), ("b", "")], "k string, t string")
    assert {(r.word, r.ct) for r in tokens.word_counts(df, "t").collect()} == {("x", 4), ("y", 2)}
    assert {(r.word, r.ct) for r in tokens.word_counts(df, "t", distinct_texts=True).collect()} == {("x", 2), ("y", 1)}
    assert {(r.k, r.n_docs, r.n_words) for r in tokens.document_stats(df, ["k"], "t").collect()} == {("a", 2, 6), ("b", 2, 0)}


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (1, "a")], "id int, k string")
    t = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("b", "?", 3)], "k string, v string, ord int")
    assert sorted((r.id, r.o) for r in lookup.lookup(df, "k", t, "k", "v", "o", F.lit("-")).collect()) == [(1, "x"), (1, "x"), (2, "?"), (3, "-")]
    assert sorted((r.id, r.k2) for r in lookup.override(df.withColumn("k2", F.lit("old")), ["k"], t, "v", "ord", "k2").collect()) == [(1, "x"), (1, "x"), (2, "old"), (3, "old")]
    assert sorted(r.id for r in lookup.allowed(df, "k", t).collect()) == [1, 1, 2]
    assert [r.id for r in lookup.missing(df, ["k"], t).collect()] == [3]
    assert sorted((r.id, r.duplicated) for r in lookup.duplicate_flag(df, "k").collect()) == [(1, True), (1, True), (2, False), (3, False)]
    assert [r.id for r in lookup.sample(df, "id", 2).collect()] == [r.id for r in lookup.sample(df.repartition(3), "id", 2).collect()]
    assert sorted((r.id, r.k) for r in lookup.patched(df.filter("k is not null"), "id", spark.createDataFrame([(2, "new")], "id int, k string"), "k").collect()) == [(1, "a"), (1, "a"), (2, "new")]
