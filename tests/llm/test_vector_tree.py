import math

import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import queries
from sievemill.llm import vector_tree as vt


def truth(ids, x, k):
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % 20 == 0:
            s = (x * v).sum(1)
            out[q] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return out


def test_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    want, got = truth(ids, x, 20), {}
    for r in queries.op9_vector_tree(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want) / (20 * len(want)) >= 0.9
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(math.isclose(s, float(at[q] @ at[i]), abs_tol=1e-12) for q in list(got)[:20] for i, s in got[q].values())


def test_recall_of_a_tree_with_many_leaves(spark, monkeypatch):
    """Clustered vectors: recall holds while a query visits less than half of the leaves."""
    monkeypatch.setattr(vt, "LEAF_ROWS", 20)
    monkeypatch.setattr(vt, "BLOCK_ROWS", 64)
    visits, search = [], vt._search

    def spy(rows, *args):
        visits.append(rows.groupBy("q").count().agg(F.avg("count")).first()[0])
        return search(rows, *args)

    monkeypatch.setattr(vt, "_search", spy)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(30, 1, 8)) * 9 + rng.normal(size=(30, 60, 8)),)).reshape(-1, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vt.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(visits) == 2 and visits[0] > 60 and visits[1] < visits[0] / 2
    want = truth(np.arange(len(x)), x, 10)
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) / (10 * len(want)) >= 0.9


def test_ties_bad_vectors_and_few_candidates(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0]), (8, []), (9, [float("inf"), 0.0]), (10, [2.0, 0.0]), (20, [0.0, 3.0]), (40, [0.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in vt.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 10, 2.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 10, 0.0)]
    assert vt.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vt.nearest(df.where("vec_id = 3"), F.lit(True)).count() == 0


def test_small_leaves_are_topped_up(spark, monkeypatch):
    """One leaf a query by the target, of fewer rows than asked for, some of them with the query's own id."""
    monkeypatch.setattr(vt, "LEAF_FIT", 4)
    monkeypatch.setattr(vt, "LEAF_ROWS", 4)
    x = np.random.default_rng(5).normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(0, 400, 20) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vt.nearest(df, F.col("vec_id") % 20 == 0, 10, target=0.0).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert set(got) == set(range(0, 400, 20)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
