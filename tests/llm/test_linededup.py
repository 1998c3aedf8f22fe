import random
from collections import defaultdict

from gramsieve.llm import linededup


def mask(line):
    out = [t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t]
    fields = [any(c in "0123456789" for c in t) for t in out]
    if fields.count(False) < 0.6 * len(out):
        return tuple(out)
    return tuple("<*>" if f else t for f, t in zip(fields, out, strict=True))


def plain(rows, least, passage=None):
    held = {(i, mask(x)) for i, t in rows for x in (t or "").split("\n") if mask(x)}
    leaves, by_leaf = defaultdict(int), defaultdict(set)
    for _, k in held:
        leaves[len(k), k[:3]] += 1
        by_leaf[len(k), k[:3]].add(k)
    at = defaultdict(int)
    for _, k in held:
        for p, t in enumerate(k):
            at[len(k), k[:3], p, t] += 1
    template = {}
    for _, k in held:
        leaf = (len(k), k[:3])
        template[k] = k
        if len(by_leaf[leaf]) > 1 and leaves[leaf] >= least:
            fixed = tuple((p, t) for p, t in enumerate(k) if 2 * at[*leaf, p, t] >= leaves[leaf])
            named = [t for _, t in fixed if t != "<*>" and not any(c in "0123456789" for c in t)]
            if len(named) >= 0.6 * len(k) and sum(p >= 3 for p, _ in fixed) >= 0.6 * (len(k) - 3):
                template[k] = (leaf, fixed)
    docs, copies = defaultdict(set), defaultdict(set)
    for i, k in held:
        docs[template[k]].add(i)
        if passage and len(k) > passage:
            copies[k].add(i)
    gone = {t: min((i for i in d if i is not None), default=None) for t, d in docs.items() if len(d) >= least}
    again = {k: min((i for i in d if i is not None), default=None) for k, d in copies.items() if len(d) > 1}
    stays = lambda k, i: gone.get(template[k], i) == i and again.get(k, i) == i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not mask(x) or stays(mask(x), i)]
        dropped = len(lines) - len(left)
        out.append((str(i), sum(bool(mask(x)) for x in lines), dropped, t if not dropped else "\n".join(left)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    random.seed(6)
    names = ["ann", "bob", "cy", "dee", "eve", "flo"]
    rows = []
    for i in range(60):
        lines = [" ".join(random.choices("aa bb cc dd ee ff gg".split(), k=random.randint(1, 12))) for _ in range(random.randint(0, 8))]
        lines += [f"please contact our {random.choice(names)} for more details today", f"posted on 2020-01-{i % 28:02d} at {i}:00", f"the meeting was posted on 2020-01-{i % 28:02d}", f"{i % 3} {i} 7", "", "  ", f"unique line number {chr(97 + i % 26)} {chr(97 + i // 26)} only"]
        lines += ["share this page now"] * (i % 3)
        random.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(i, f"{'long line ' * 30}{j} {'told ' * (j % 4)}") for j, i in enumerate([3, 70, 9, 71, None, None])]
    rows += [(60, None), (61, ""), (None, "share this page now\nfine"), (5, "share this page now"), (5, "share this page now"), (62, "x " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, N_LINES string")
    want = plain(rows, 8, 50)
    assert plain(rows, 8) != want and any("contact" in str(r) for r in want) and sum(r[2] for r in want) > 60
    for small in (0, linededup.SMALL):
        linededup.SMALL, old = small, linededup.SMALL
        got = sorted(((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in linededup.drop_recurring(df, min_docs=8, passage=50).collect()), key=str)
        linededup.SMALL = old
        assert got == want


def test_empty_table(spark):
    assert linededup.drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_lookups_are_not_broadcast(spark, monkeypatch):
    """Copies of a lookup table of over SMALL rows must not go through the driver, however small Spark takes it for."""
    plans, cut = [], linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df, *a: (df.collect(), plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *a))[2])
    monkeypatch.setattr(linededup, "SMALL", 2)
    rows = [(i, "\n".join(f"please contact {a} {b} for more details" for a in "abc" for b in ("today", "now"))) for i in range(12)]
    out = linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), passage=50)
    assert sum(r.n_dropped for r in out.collect()) == 11 * 6
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    salted = [p for p in plans if "__salt" in p]
    assert salted and not any("BroadcastHashJoin" in x and "__salt" in x for p in salted for x in p.splitlines())
