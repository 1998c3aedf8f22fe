import math
import re
from collections import Counter

from gramsieve.llm import licences, queries

ROWS = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/x/COPYING.txt", "This program is free software: you can redistribute it and/or modify it under the terms\nof the GNU General Public License as published by the Free Software Foundation,\neither version 3 of the License"),
    ("a/f.txt", "words of a plain text\nand more"),
    ("a/x/y/f.txt", "no licence here"),
    ("a/x/g.txt", "some text\nLicensed under CC BY-NC 4.0.\nmore text"),
    ("b/f.txt", "nothing under this license of the public that general version"),
    ("b/h.txt", "prose\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nprose"),
    ("c", None), (None, "Released under the MIT License."), (None, "plain"), ("a/f.txt", ""), ("a/f.txt", "\n\n"), ("root.txt", "word " * 50_000 + "\nReleased under the MIT License.\n" + "é世界 " * 50_000),
]


def plain(texts):
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    n = len(texts)
    df = Counter(w for t in texts for w in set(split(t or "")))
    known = {w for _, t in licences.TEMPLATES for w in split(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in known else 0))) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(split(t)).items()}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0.0

    out = []
    for t in texts:
        lines = (t or "").split("\n")
        units = lines + ["\n".join(lines[max(i, 0) : i + 3]) for i in range(-2, len(lines))] + [t or ""]
        score, name = max(((cosine(vector(u), vector(x)), k) for u in units for k, x in licences.TEMPLATES), key=lambda s: s[0])
        out.append((name, score) if score >= licences.LEAST else (None, None))
    return out


def test_scores_against_brute_force_and_inheritance(spark):
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(ROWS)], "doc_id long, path string, text string, LICENCE string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(got) == len(ROWS)
    for i, (name, score) in enumerate(plain([t for _, t in ROWS])):
        r = got[i]
        if name:
            assert (r.licence, r.origin) == (name, "own") and abs(r.score - score) < 1e-9, (i, r, name, score)
        else:
            assert r.origin != "own", (i, r)
    assert got[4].licence == "CC-BY-NC-4.0" and got[4].line == 2
    assert got[6].licence == "Apache-2.0" and got[6].line == 2
    assert (got[2].licence, got[2].origin, got[2].origin_dir) == ("MIT", "inherited", "a")
    assert (got[3].licence, got[3].origin, got[3].origin_dir) == ("GPL-3.0", "inherited", "a/x")
    assert got[10].licence == got[11].licence == "MIT"
    assert got[5].licence is None and got[7].licence is None and got[9].licence is None and got[8].licence == "MIT"
    assert got[12].licence == "MIT" and got[12].line == 2


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_query_inherits(spark, tmp_path):
    """The query's paths: a source's, a language's and a folder's licence file, and documents below them."""
    rows = [(i, "Licensed under the MIT License." if i in (0, 16, 32) else "plain words", "s", "en") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_licences(spark, str(tmp_path)).collect()}
    assert len(got) == 50 and {r.origin for r in got.values()} == {"own", "inherited"}
    assert (got[0].path, got[16].path, got[32].path) == ("s/en/0/LICENSE", "s/LICENSE", "s/en/LICENSE")
    assert [(got[i].origin, got[i].origin_dir) for i in (0, 1, 17, 33, 48)] == [("own", "s/en/0"), ("inherited", "s/en/0"), ("inherited", "s/en"), ("inherited", "s/en"), ("inherited", "s/en")]
