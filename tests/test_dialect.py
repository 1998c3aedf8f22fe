import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from pyspark.sql import functions as F

from gramsieve.functions.dialect import PatternError, to_java, to_linear
from gramsieve.operators.search import MARKS, _places, find_matches, matching_files, scan_stats
from gramsieve.plans import literals as L

#: (pattern, text, matches), one or more for each construct of the language's documented syntax
CASES = [
    # one character
    ("h.t", "hat hot h\nt ht", ["hat", "hot"]), ("(?s)h.t", "h\nt", ["h\nt"]), (r"[0-9]\D", "7x 77 8y", ["7x", "7 ", "8y"]), (r"\d+", "room 101, ٣", ["101", "٣"]), (r"\s+", "a b\t\u00a0c", [" ", "\t\u00a0"]),
    (r"\S+", "two words", ["two", "words"]), (r"\w+", "naïve_9 ok", ["naïve_9", "ok"]), (r"\W", "a-b", ["-"]), (r"\pN+", "x42y", ["42"]), (r"\p{Cyrillic}+", "да no нет", ["да", "нет"]), (r"\P{L}+", "ab12cd", ["12"]), (r"\p{Lu}", "aBcD", ["B", "D"]),
    # classes
    ("[xyz]+", "axyzb", ["xyz"]), ("[^xyz]+", "axyzb", ["a", "b"]), ("[p-s]+", "opqrst", ["pqrs"]), ("[[:digit:]]+", "a12b", ["12"]), ("[[:^alpha:]]+", "ab12", ["12"]), ("[a-m&&[^c-e]]+", "abcdefm", ["ab", "fm"]),
    ("[0-9--4]+", "3456", ["3", "56"]), ("[a-g~~b-h]+", "abgh", ["a", "h"]), (r"[\]\-x]+", "-]x.", ["-]x"]), ("[]}]+", "}]{", ["}]"]), (r"[\w.]+@", "me.you@ @", ["me.you@"]),
    # one after another, one or another; the first branch that fits wins
    ("sun|sunny", "sunny", ["sun"]), ("sunny|sun", "sunny sun", ["sunny", "sun"]), ("(?:r|)ing", "ring ing", ["ring", "ing"]),
    # repeats
    ("go*l", "gl gol gooool", ["gl", "gol", "gooool"]), ("go+l", "gl gol", ["gol"]), ("honou?r", "honor honour", ["honor", "honour"]), ("z{3}", "zzzzzzz", ["zzz", "zzz"]), ("z{2,}", "z zz zzzz", ["zz", "zzzz"]), ("z{2,3}", "zzzzz", ["zzz", "zz"]),
    ("<.+?>", "<a><b>", ["<a>", "<b>"]), ("(?U)<.+>", "<a><b>", ["<a>", "<b>"]), ("q{1,3}?", "qqq", ["q", "q", "q"]), ("(?:no){0}yes", "yes", ["yes"]), ("b*", "abb", ["", "bb"]), ("(?:la)+", "lalala la", ["lalala", "la"]),
    # places
    ("^top", "top\ntop", ["top"]), ("(?m)^top$", "top\ntop\nstop", ["top", "top"]), (r"\Atop", "top top", ["top"]), (r"end\z", "end end", ["end"]), ("end$", "end\n", []), (r"\bin\b", "in inn win", ["in"]), (r"\Bin", "in win", ["in"]),
    # groups and flags
    ("(?P<year>19|20)84", "1984 2084", ["1984", "2084"]), ("(?<d>x)y", "xy", ["xy"]), ("(?i)straße", "STRAßE", ["STRAßE"]), ("a(?i)b", "aB AB", ["aB"]), ("(?i:a)b", "Ab AB", ["Ab"]), ("(?i)a(?-i)b", "Ab AB", ["Ab"]), ("(?x) t o # note\n p", "top", ["top"]),
    # escapes
    (r"\x2B\u{2192}", "+→", ["+→"]), (r"\t\n", "\t\n", ["\t\n"]), (r"1\.5\$", "1.5$ 125$", ["1.5$"]),
    # nothing to find
    ("dawn", "", []),
]
BAD = ["[open", "x{2", "v(?=w)", "v(?!w)", "(?<=v)w", r"(v)\1", "v*+", "+v", "(v", "v)", "v{5,2}", r"\y", "[[:vowel:]]", "[z-a]", "(?<n>a)(?<n>b)"]


def test_matches(spark):
    df = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(CASES)], "path long, text string").coalesce(1).cache()
    for i, (pattern, text, want) in enumerate(CASES):
        got = [r.text for r in sorted(find_matches(df.filter(F.col("path") == i), pattern).collect())]
        assert got == want, (pattern, text, got, to_java(pattern))


@pytest.mark.parametrize("pattern", BAD)
def test_rejected(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_positions_are_bytes(spark):
    df = spark.createDataFrame([("a", "ab世界cd"), ("b", "x\ncd\n\nééd cd"), ("c", "\x01cd\x02 \x01cd")], "path string, text string")
    got = sorted((r.path, r.line, r.col) for r in find_matches(df, "cd").collect())
    assert got == [("a", 1, 9), ("b", 2, 1), ("b", 4, 7), ("c", 1, 2), ("c", 1, 7)]


def test_every_mark_in_a_text(spark):
    text = "".join(a + b for a, b in MARKS) + "\nxcd cd"
    got = sorted((r.line, r.col, r.text) for r in find_matches(spark.createDataFrame([("a", text)], "path string, text string"), "cd").collect())
    assert got == [(2, 2, "cd"), (2, 5, "cd")]


def test_long_texts(spark):
    """Work grows with the text, and repeated groups don't go deeper with each repeat."""
    words = "ab cd\n" * 75_000
    df = spark.createDataFrame([(1, words), (2, "foobar" * 170_000 + "baz"), (3, "foobar" * 170_000), (4, None), (5, "")], "path long, text string")
    found = find_matches(df, r"\w+").filter("path = 1").agg(F.count("*"), F.max("line"), F.sum("col")).head()
    assert tuple(found) == (150_000, 75_000, 75_000 * 5)
    assert [(r.path, r.line, r.col, len(r.text)) for r in find_matches(df, "(foo|bar)+baz").collect()] == [(2, 1, 1, 6 * 170_000 + 3)]
    assert [r.path for r in matching_files(df, "(foo|bar)+baz").collect()] == [2]
    assert tuple(scan_stats(df, "(foo|bar)*baz").head())[2:] == (1, 1)
    assert [r.path for r in matching_files(df, r"^(\w+\s?)*$").collect()] == [1, 2, 3, 5]


#: Patterns that both engines can run.
DEEP = ["(a|bc)*d", "(?:[ab]+c?)*", r"(\w+ )+", "(?i)(A|b)+", r"(?m)^(a+b?)+$", r"([a-c]+|\d)*?c", "(a|)+b", "((a|b)*c)*"]


@pytest.mark.parametrize("pattern", DEEP)
def test_engines_agree(pattern):
    linear = to_linear(pattern)
    assert linear is not None and to_linear(r"\b(a|b)*\b") is None and to_linear("(?:ab)*c") is None
    random.seed(pattern)
    for _ in range(300):
        text = "".join(random.choices("abcd é1\n", k=random.randint(0, 14)))
        want, at = [], -1
        for m in regex.finditer(pattern, text, flags=regex.V0):
            if m.group() or m.start() != at:
                want.append(m.group())
            at = m.end()
        marked = pc.replace_substring_regex(pa.array([text]), f"({linear})", "\x01\\1\x02")[0].as_py()
        assert [x[2].decode() for x in _places(marked.encode(), b"\x01", b"\x02")] == want, (pattern, text)


def test_literals_are_sound():
    """Whatever matches holds the literals, on random patterns and texts over a small alphabet."""
    random.seed(42)

    def pattern(depth):
        kind = random.randrange(9)
        if depth == 0 or kind < 3:
            return random.choice(["a", "b", "c", "ab", "[ab]", "[^a]", ".", "(?i:k)", r"\x61"])
        if kind == 3:
            return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})"
        if kind == 4:
            return f"(?:{pattern(depth - 1)}){random.choice(['?', '*', '+', '{2}', '{0,2}', '{1,3}', '{0}'])}"
        return pattern(depth - 1) + pattern(depth - 1)

    texts = ["".join(random.choices("abck", k=random.randint(0, 10))) for _ in range(60)]
    hits = 0
    for _ in range(1500):
        p = pattern(4)
        tree = L.required(p)
        for t in texts:
            if regex.search(p, t):
                hits += 1
                assert tree is None or L.holds(tree, lambda x, t=t: x in t), (p, t, tree)
    assert hits > 5000


@pytest.mark.parametrize(("pattern", "text"), [(p, t) for p, t, want in CASES if want and p != "b*"])
def test_literals_of_cases(pattern, text):
    tree = L.required(pattern)
    assert tree is None or L.holds(tree, lambda x: x in text)


def test_files(spark):
    df = spark.createDataFrame([("a", "oak tree"), ("b", "elm tree"), ("c", "oaktree"), ("d", None)], "path string, text string")
    assert {r.path for r in matching_files(df, "(oak|elm) tree").collect()} == {"a", "b"}
    assert re.search("oak tree", matching_files(df, "(oak|elm) tree")._jdf.queryExecution().toString())
