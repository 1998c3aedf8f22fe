import random

import corpus_pipeline
from gramsieve.llm import linededup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, stage, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.text for r in stage(spark, docs, "").collect()}


def test_different_lines_with_one_opening_stay(spark):
    letters = "abcdefghijkl"
    texts = [f"There was a {c}ow {c}en\nThere was a {c}at\nPlease read all of our {c}ar rules here today" for c in letters]
    got = staged(spark, corpus_pipeline.line_dedup, texts)
    assert got == {i: t if not i else t.rsplit("\n", 1)[0] for i, t in enumerate(texts)}


def test_rows_of_numbers_stay_unless_equal(spark):
    texts = [f"{i} {40 * i} 7\n2020-01-{i + 10} {i}:00\n1 2 3\nposted on 2020-01-{i + 10} at {i}:00\n5 5 5 5 8 {i} {i} {i}" for i in range(12)]
    got = staged(spark, corpus_pipeline.line_dedup, texts)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert got[i].split("\n") == (lines if not i else [*lines[:2], lines[4]])


def test_passages_of_over_50_words_stay_in_one_document(spark):
    random.seed(4)
    text = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    passage, at_most = text(51), text(50)
    texts = [f"{text(80)}\n{passage}\n{text(30)}\n{at_most}" for _ in range(3)] + [passage + " 7\n" + text(20)]
    got = staged(spark, corpus_pipeline.near_dedup, texts)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert got[i].split("\n") == (lines if i in (0, 3) else [lines[0], *lines[2:]])


def test_passages_over_null_ids_and_whole_documents(spark):
    passage = "word " * 60
    rows = [(7, passage), (None, passage + "\nmore"), (3, "x\n" + passage), (9, None), (11, ""), (3, passage)]
    got = linededup.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_dropped, str(r.text)) for r in got) == sorted([("7", 1, ""), ("None", 1, "more"), ("3", 0, "x\n" + passage), ("9", 0, "None"), ("11", 0, ""), ("3", 0, passage)])
    assert linededup.drop_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
