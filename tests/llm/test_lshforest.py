import random

from gramsieve.llm import lshforest
from gramsieve.llm.components import components


def shingles(text, k):
    w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k, percent=80):
    sets = [shingles(t, k) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(top(i), []).append(r[0])
    return sorted((str(r[0]), len(sets[i]), str(min((x for x in low[top(i)] if x is not None), default=None))) for i, r in enumerate(rows))


def corpus():
    random.seed(3)
    vocabulary = [f"{a}{b}" for a in "bcdfghjk" for b in ("a", "e", "is", "on")]

    def text(n):
        return [random.choice(vocabulary) for _ in range(n)]

    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, words if words is None or isinstance(words, str) else " ".join(words)))
        at += 1

    for _ in range(30):
        add(text(random.randint(1, 200)))
    base = text(120)
    for _ in range(80):  # a dense region: edits at random places
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        add(w)
    chain = text(100)
    for i in range(12):  # each is near the next, the ends are not alike
        add(chain[i * 4 :] + text(0) + [f"t{j}" for j in range(i * 4)])
    for odd in (None, "", " \n\t", "one", "ONE", "one two three", "One Two\tthree", "one two"):
        add(odd)
    long = text(5000)
    add(long)
    add([w.upper() for w in long] + ["tail"])
    rows += [(None, "one two three"), (None, None), (3, rows[3][1]), (5, "other text with the same id"), (5, "other text with the same id")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, N int")
    for k in (4,):
        got = lshforest.near_duplicates(df.repartition(5), words=k).collect()
        want = plain(rows, k)
        # rows without an id in an empty set have no component
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert lshforest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    part = {x: x for e in edges for x in e}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        part[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b and a not in got}
    assert got == {x: top(x) for x in part if x not in alone}


def test_dense_neighbourhood(spark, monkeypatch):
    """More rows than a region holds: copies with few and with many edits, some linked with one other row alone."""
    monkeypatch.setattr(lshforest, "REGION", 4)
    random.seed(9)
    base = [f"w{random.randrange(900)}" for _ in range(150)]

    def edited(words, n):
        w = list(words)
        for at in random.sample(range(len(w)), n):
            w[at] = f"x{random.randrange(10**6)}"
        return w

    rows = [edited(base, random.choice([0, 1, 2, 3, 5, 7, 9, 12])) for _ in range(150)]
    rows += [edited(r, 2) for r in rows[-30:]] + [base[: random.randrange(110, 150)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lshforest.near_duplicates(df, words=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain(rows, 4)
