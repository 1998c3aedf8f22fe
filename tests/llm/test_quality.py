from collections import Counter

from gramsieve.llm import quality

COLUMNS = "doc_id long, text string, N_WORDS string, source string"
TEXTS = [
    None,
    "",
    " \t\n ",
    "one two three",
    "a b c d e " * 4,
    "the quick brown fox jumps over the lazy dog and runs away home",
    "the quick brown fox jumps over the lazy dog and runs away home",
    "line one here\nline one here\nline two there\n\n\nother words go on and on until ten",
    "# * $ % & | < > word again word once more word here",
    " ".join(f"w{i}" for i in range(30_000)),
    "x" * 200_000 + " é世界 y " + "z " * 20,
]


def words(t):
    out, cur = [], ""
    for ch in t:
        if ch in " \t\n\x0b\x0c\r":
            out += [cur] if cur else []
            cur = ""
        else:
            cur += ch
    return out + ([cur] if cur else [])


def plain(t):
    t = t or ""
    w = words(t)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered))


def rows(spark):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(TEXTS)], COLUMNS)


def test_measurements_against_brute_force(spark):
    got = {r.doc_id: r for r in quality.ledger(rows(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), i


def test_verdicts_and_ablation(spark):
    book = quality.ledger(rows(spark))
    kept = {r.doc_id for r in quality.judge(book, "v1").filter("kept").collect()}
    assert {5, 6, 9} <= kept and not {0, 1, 2, 3, 4, 8} & kept
    bits = [r.fail_bits for r in book.collect()]
    for r in quality.ablate(book).collect():
        m = quality.mask(r.policy)
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_docs == len(bits)
        assert r.n_rejected == sum(b & m != 0 for b in bits)
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_only_this == sum(b & m == bit for b in bits)


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert quality.judge(quality.ledger(none)).count() == 0
    assert quality.ablate(quality.ledger(none)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = quality.judge(quality.ledger(rows(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
