import numpy as np
from pyspark.sql import functions as F

from gramsieve.llm import permutation


def exact(ids, x, q, k=10):
    far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(far[i])) for i in order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in permutation.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(got) == 30
    hits = 0
    for q, near in got.items():
        assert sorted(near) == list(range(1, 11))
        want = exact(ids, x, q)
        hits += len({v for v, _ in near.values()} & {v for v, _ in want})
        for v, s in near.values():
            assert abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12
    assert hits / 300 >= 0.9


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, []), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in permutation.search(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]


def test_empty_table(spark):
    assert permutation.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_several_blocks(spark):
    """Many blocks, none of which is ranked whole."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 24)) + 2 * rng.normal(size=(30, 24))[rng.integers(0, 30, 8000)]
    ids = np.arange(8000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    assert 8000 / 7 * permutation.SHARE >= permutation.LEAST
    got = {}
    for r in permutation.search(df, F.col("vec_id") % 100 == 0, block=1200).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(near) & {v for v, _ in exact(ids, x, q)}) for q, near in got.items())
    assert len(got) == 80 and hits / 800 >= 0.9


def test_blocks_and_queries_are_not_broadcast(spark):
    """Query packs meet every block of the index; their copies must not go through the driver."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = permutation.search(df, F.col("vec_id") % 2 == 0, k=3, block=500)
    assert len({r.query_id for r in found.collect()}) == 1500
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
