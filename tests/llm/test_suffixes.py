import random
from collections import Counter

import numpy as np
import pytest

from gramsieve.llm import suffixes


def plain(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                covered[i : i + span] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int)])))
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out


def corpus():
    random.seed(4)

    def noise(n):
        return "".join(random.choices("abcdefg hij\néß", k=n))

    passage = noise(700)
    texts = [noise(random.randint(0, 900)) for _ in range(25)]
    texts += [noise(random.randint(0, 300)) + passage[random.randint(0, 200) : random.randint(500, 700)] + noise(100) for _ in range(25)]
    texts += [passage, passage, passage + passage, "z" * 1500, None, "", "x", noise(50_000), noise(30) + "z" * 450]
    return texts


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_block_sort_against_brute_force(alphabet):
    random.seed(7)
    base = "".join(random.choices(alphabet, k=1500)).encode()
    text = base + base[50:400] + b"a" * 300 + base[700:1100]
    span = 140
    starts = np.arange(len(text) - span + 1)
    seen = Counter(text[i : i + span] for i in starts)
    want = [seen[text[i : i + span]] > 1 for i in starts]
    assert suffixes.repeated_starts(np.frombuffer(text, np.uint8), starts, span).tolist() == want


@pytest.mark.parametrize("most", [20_000, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, texts[0], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = suffixes.without_spans(suffixes.repeated_passages(df)).collect()
    want = plain([t for _, t, _ in rows], 400)
    key = lambda i, d, s: (str(i), d, s)
    assert sorted(key(r.doc_id, bytes(r.content), [tuple(x) for x in r.spans]) for r in got) == sorted(key(i, (t or "").encode(), w) for (i, t, _), w in zip(rows, want, strict=True))
    for r in got:
        kept, at = b"", 0
        for s, e in r.spans:
            kept, at = kept + bytes(r.content)[at:s], e
        assert bytes(r.kept) == kept + bytes(r.content)[at:]


def test_empty_table(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
