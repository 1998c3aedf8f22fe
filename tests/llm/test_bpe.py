import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gramsieve.llm import bpe
from gramsieve.llm.queries import rank_path


@pytest.fixture(scope="module")
def plain():
    return bpe.encoding(bpe.read_ranks(rank_path()), P.PATTERN)


def test_pieces_encode_as_the_whole(plain):
    fast = bpe.encoding(bpe.read_ranks(rank_path()), bpe.FAST)
    random.seed(1)
    letters = list("ab c 1 2\n\t\r\x1c\x85　' 's 'll'LL d! ?世é́")
    for _ in range(3000):
        s = "".join(random.choices(letters, k=random.randint(0, 40)))
        assert plain.encode_ordinary(s) == [i for _, x in bpe.pieces(s, 3) for i in fast.encode_ordinary(x)]


@pytest.mark.parametrize("text", ["a" + " " * 9000 + "b", "x\n" + "\n" * 5000, ("x y" * 3 + " " * 5000) * 3, "ab " * 60000])
def test_long_runs(plain, text):
    assert list(bpe.encode_text(plain, text)) == plain.encode_ordinary(text)


def test_white_space_too_long_for_the_pattern(plain):
    text = " " * 1_000_000 + "z"
    assert plain.decode_bytes(bpe.encode_text(plain, text).tolist()) == text.encode()


def test_round_trip_and_odd_rows(spark, plain):
    texts = ["", None, "Grüße, 世界 <|endoftext|>", "same", "same", "\x00\n \n"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, TOKEN_IDS string")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, rank_path()), rank_path()).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].token_ids == plain.encode_ordinary(t or "")
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, rank_path()), rank_path()).count() == 0


def test_query_digests(spark, plain):
    from gramsieve.llm.queries import op1_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
