from pyspark.sql import functions as F

from monthloom.operators import embedding, panel, tokens
from monthloom.plans import wide
from monthloom.sources import tables


def test_united_and_widened(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(2, 9, 5), (3, 9, 6)], "k int, x int, y int")
    assert sorted((r.k, r.x, r.y) for r in panel.united([a, b], ["k"]).collect()) == [(1, 1, None), (2, 2, 5), (3, None, 6)]
    w = panel.widened(spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "z", 4), (2, "b", 1)], "k int, n string, v int"), ["k"], "n", ["a", "b"], "v")
    assert sorted((r.k, r.a, r.b) for r in w.collect()) == [(1, 5, None), (2, None, 1)]


def test_names_of_columns(spark):
    assert wide.column_names([["w"], ["", "out"], ["3m"]]) == ["w_3m", "w_out_3m"]
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, key int, c int")
    assert wide.renamed(df, "3m", ["key"]).columns == ["a_b_3m", "key", "c_3m"]
    assert wide.ordered(df, ["c", "nope", "c", "key"]).columns == ["c", "key"]
    assert wide.shortened(df, {"key": "k", "A ": "a_"}).columns == ["a_b", "k", "c"]


def test_cached(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert [tables.cached(spark, path, build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    tables.cached(spark, path, build, load_saved=False)
    assert len(calls) == 2


def test_embeddings(spark):
    rows = [(i, "red apple sweet fruit" if i % 2 else "fast car loud engine") for i in range(40)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert sorted(r.n_rows for r in embedding.document_ids(df, "t").collect()) == [1, 20, 20]
    m = embedding.trained(df, "t", size=4, least=1)
    v = {r.id: r.vector for r in embedding.document_vectors(df, "t", m).collect()}
    assert len(v[1]) == 4 and v[1] == v[3] and v[1] != v[2] and v[98] == [0.0] * 4 and v[99] is None
    again = {r.id: r.vector for r in embedding.document_vectors(df, "t", embedding.trained(df, "t", size=4, least=1)).collect()}
    assert again == v


def test_dictionary_summaries(spark):
    v = spark.createDataFrame([("a", 5, "x", None, 1, "pos_nonword"), ("b", 2, "y", "z", 0, "pos_word"), ("c", 1, None, None, 1, "neg_nonword")], "word string, ct long, nasa string, faa string, abrev int, tag string")
    assert {tuple(r) for r in tokens.dictionary_summary(v, ["nasa", "faa"]).collect()} == {("nasa", 7, 2), ("faa", 2, 1), ("any", 7, 2)}
    assert {tuple(r) for r in tokens.dictionary_sets(v, ["nasa", "faa"]).collect()} == {("abrvs", "a"), ("abrvs", "c"), ("pos_nonword", "a"), ("nasa", "a")}
    assert {r.n_unique for r in tokens.dictionary_summary(v.filter(F.lit(False)), ["nasa"]).collect()} == {0}


def test_flags_of_several_lists(spark):
    v = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "word string, ct long")
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = {r.word: (r.p, r.q) for r in tokens.flags(v, {"p": one("a", "a"), "q": one("a", "b")}).collect()}
    assert got == {"a": (True, True), "b": (False, True), None: (False, False)}
