"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver and travels to the executors as a broadcast of checked size (a vocabulary does
not grow with the corpus). Texts pass through Arrow batches; long texts are first split where every match of the
pre-tokeniser must end anyway, so that the pieces encode to the same ids as the whole and no regular expression or merge
ever sees an unbounded string of many words.

Defined results: a null text encodes to the ids of the empty text, which are none; a null list of ids decodes to no
bytes; ids outside the vocabulary raise KeyError. Columns named as the operator's output are replaced; all others stay.
Empty tables give empty tables; repeated rows are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gramsieve.llm.common import without
from gramsieve.shipping import ship

#: The largest rank file that is broadcast.
MAX_RANK_BYTES = 32 << 20
#: Characters from which a text is split before encoding, and the size of its pieces.
LONG_TEXT = 1 << 16
#: White space of the pre-tokeniser's \s (Unicode White_Space), as fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
#: A place where every match ends: a character that is no white space, then a space or line feed.
_EDGE = re.compile(f"(?<=[^\\x1c-\\x1f{SPACE}])(?=[ \\n])")
#: Long runs of white space, which a backtracking pattern can't take in one match; the pre-tokeniser matches such a run at
#: once up to its last character, and wholly at the end of a text.
_RUN = re.compile(f"[{SPACE}]{{4096,}}")

#: tiktoken's own pattern for this vocabulary family; it is equivalent to PATTERN of the vocabulary's README and never backtracks.
FAST = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODINGS: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: {len(data)} bytes of ranks; at most {MAX_RANK_BYTES} are broadcast")
    return data


def encoding(data: bytes, pattern: str):
    """One tiktoken Encoding a Python worker; ranks are parsed once."""
    import tiktoken

    key = hash((data, pattern))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def pieces(text: str, size: int = LONG_TEXT) -> Iterator[tuple[bool, str]]:
    """Splits a text where every match of the pre-tokeniser ends. True marks a run of white space that is one match."""
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield from ((False, x) for x in _parts(text, at, m.start(), size))
        yield True, text[m.start() : end]
        at = end
    yield from ((False, x) for x in _parts(text, at, len(text), size))


def _parts(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        m = _EDGE.search(text, at + size, end)
        if not m or m.start() >= end:
            break
        yield text[at : m.start()]
        at = m.start()
    if end > at:
        yield text[at:end]


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= 4096:
        return enc.encode_to_numpy(text, disallowed_special=())
    found = [np.asarray(enc._encode_single_piece(x), np.uint32) if whole else enc.encode_to_numpy(x, disallowed_special=()) for whole, x in pieces(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def encode(df: DataFrame, rank_path: str, text: str = "text", ids: str = "token_ids", pattern: str = FAST) -> DataFrame:
    """Adds ``ids``, the token ids (array of int) of column ``text``; no special tokens."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))
    df = without(df, [ids])
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [encode_text(enc, x) for x in batch.column(names.index(text)).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, ids: str = "token_ids", out: str = "decoded", pattern: str = FAST) -> DataFrame:
    """Adds ``out``, the raw bytes that the ids in ``ids`` stand for (binary; they need not be valid UTF-8)."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))
    df = without(df, [out])
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            lists = batch.column(names.index(ids))
            found = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, out])

    return df.mapInArrow(run, schema)
