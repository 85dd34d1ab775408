import numpy as np
from pyspark.sql import functions as F

from monthloom.operators import vectors as v


def _pairs(x, y=None):
    u = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    c = u(x) @ u(x if y is None else y).T
    return c[np.triu_indices(len(x), 1)] if y is None else c.ravel()


def test_against_all_pairs(spark):
    r = np.random.default_rng(1)
    groups = {"a": 1, "b": 2, "c": 3, "d": 7}
    rows = [(g, r.normal(size=5)) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame([(g, x.tolist()) for g, x in rows] + [("a", None)], "entity string, e array<double>")
    got = {x.entity: x for x in v.similarities(v.unit_sums(df, ["entity"], "e", 5), 5).collect()}
    for g, n in groups.items():
        own, out = np.array([x for k, x in rows if k == g]), np.array([x for k, x in rows if k != g])
        every = np.array([x for _, x in rows])
        near = lambda a, b: b is not None and abs(a - b) < 2e-6
        assert got[g].own_sim is None if n < 2 else near((1 + _pairs(own).mean()) / 2, got[g].own_sim)
        assert near((1 + _pairs(out).mean()) / 2, got[g].out_sim)
        assert near((1 + _pairs(own, every).mean()) / 2, got[g].invall_sim)
        assert near((1 + _pairs(own, out).mean()) / 2, got[g].invout_sim)


def test_zero_vectors_count_without_adding(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [1.0, 0.0])], "entity string, e array<double>")
    r = v.unit_sums(df, ["entity"], "e", 2).first()
    assert (r.n, r.s) == (2, [1.0, 0.0])
    assert df.select(v.cosine(F.col("e"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).orderBy("c").collect()[0].c is None


def test_lagged(spark):
    df = spark.createDataFrame([("a", m, m, [float(m)]) for m in range(1, 6)], "entity string, month_idx int, n int, s array<double>")
    got = {r.month_idx: (r.n, r.s[0]) for r in v.lagged_sums(df, 1, 2, 1).collect()}
    assert got == {1: (0, 0.0), 2: (1, 1.0), 3: (3, 3.0), 4: (5, 5.0), 5: (7, 7.0)}


def test_empty(spark):
    e = spark.createDataFrame([], "entity string, e array<double>")
    assert v.similarities(v.unit_sums(e, ["entity"], "e", 3), 3).count() == 0
