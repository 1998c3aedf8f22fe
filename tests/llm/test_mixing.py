from pyspark.sql import functions as F

from gramsieve.llm import mixing

SCHEMA = "doc_id long, source string, text string, SIZE string, __x int"


def corpus(spark, n=3000):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", " ".join(["w"] * (1 + (i * 7919) % 40 + (900 if i % 500 == 1 else 0))), "clash", 1) for i in range(n)]
    rows += [(n + i, None, "a b c d", "clash", 1) for i in range(50)]
    rows += [(None, "s1", "x y", "clash", 1)] * 3 + [(n + 99, "s2", None, "clash", 1), (n + 98, "s2", "", "clash", 1), (5, "s5", "same row", "clash", 1), (5, "s5", "same row", "clash", 1)]
    rows += [(n + 200, "empty source", "", "clash", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def shares(sizes: dict) -> dict:
    """Plain rounds of capping and resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)


def test_targets_and_taken(spark):
    df, rows = corpus(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.size == len((r.text or "").split())
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = shares(sizes)
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 and sizes[s] for s in want)  # some source stops
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]), s
        assert abs(taken[s] - want[s]) <= 60, (s, taken[s], want[s])
    assert sum(target.values()) - sum(sizes.values()) < 1e-6


def test_reruns_agree_whatever_the_partitioning(spark):
    df, _ = corpus(spark, 1200)
    key = ["source", "doc_id", "size", "taken"]
    a = sorted(mixing.mix(df).select(*key).collect(), key=str)
    b = sorted(mixing.mix(df.repartition(7, F.rand(3))).select(*key).collect(), key=str)
    assert a == b
    c = sorted(mixing.mix(df, seed=1).select(*key).collect(), key=str)
    assert a != c


def test_expectation_is_kept(spark):
    units = spark.range(60_000).selectExpr("'s' source", "id doc_id", "id % 50 + 1 size", "1L n", "0.3D rate", "60000L n_units")
    got = mixing.decide(units).selectExpr("sum(p)", "sum(p * size)", "count(*)").head()
    assert got[2] == 60_000 and abs(got[0] / 60_000 - 0.3) < 0.01 and abs(got[1] - 0.3 * 1_530_000) <= 50


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
