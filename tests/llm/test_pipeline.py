import random

import corpus_pipeline
from gramsieve.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_rows(spark):
    random.seed(8)
    words = [a + b for a in "b c d f g h k l m".split() for b in ("ar", "en", "io", "ust")]
    text = lambda n: " ".join(random.choices(words, k=n))
    rows = [(i, "\n".join([text(40), f"own words of {chr(97 + i)} {text(30)}", "read more of this on our site"]), "en", f"s{i % 4}", 0) for i in range(20)]
    base = rows[3][1].split("\n")[0] + " " + text(60)
    rows += [(100 + i, base + (f" tail{i}" if i % 2 else ""), "en", "s1", 0) for i in range(6)]
    rows += [(200, "few words", "en", "s0", 0), (201, None, "en", "s0", 0), (202, "", "en", None, 0), (203, "a b c d e " * 40, "en", "s0", 0), (204, "x # % # % # % " * 20, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "").cache()
        seen[name] = at.collect()
        if name != "encode":
            assert at.columns == docs.columns
    assert {r.doc_id for r in seen["quality_rules"]} == {*range(20), *range(100, 106)}
    lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert [i for i, r in lines.items() if "read more" in r.text] == [0]
    assert set(lines) == {*range(20), *range(100, 106)} and all(r.n_chars == len(r.text) for r in lines.values())
    assert {r.doc_id for r in seen["near_dedup"]} == {*range(20), 100}
    kept = {r.doc_id: r.text for r in seen["near_dedup"]}
    copies = {}
    for r in seen["mix_sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == kept[r.doc_id]
    assert max(copies.values()) <= mixing.MOST and set(copies) <= set(kept)
    assert len(seen["encode"]) == len(seen["mix_sources"]) and all(r.round_trip and r.n_tokens == len(r.token_ids) > 0 for r in seen["encode"])


def test_empty_documents(spark):
    at = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "")
    assert at.count() == 0
    assert quality.mask("v1") == 63
