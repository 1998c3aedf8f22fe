"""Byte n-grams: trigrams, and sparse grams between locally heaviest byte pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramsieve.shipping import ship


@cache
def weights() -> np.ndarray:
    """The rank of each byte pair by its MD5; only the order of weights matters."""
    digests = [hashlib.md5(bytes(divmod(p, 256))).digest() for p in range(1 << 16)]
    out = np.empty(1 << 16, np.int64)
    out[sorted(range(1 << 16), key=digests.__getitem__)] = np.arange(1 << 16)
    return out


def pair_weights(data: bytes) -> list[int]:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return weights()[b[:-1] << 8 | b[1:]].tolist() if len(b) > 1 else []


def trigrams(data: bytes) -> list[bytes]:
    """All different windows of 3 bytes, in order; fewer than 3 bytes have none."""
    return sorted({data[i : i + 3] for i in range(len(data) - 2)})


def sparse_spans(data: bytes) -> list[tuple[int, int]]:
    """Every pair of bytes, and every span between two pairs that both outweigh all pairs between them, as [start, end)."""
    w = pair_weights(data)
    out, stack = {(i, i + 2) for i in range(len(w))}, []
    for j, x in enumerate(w):
        while stack and w[stack[-1]] < x:
            out.add((stack.pop(), j + 2))
        if stack:
            out.add((stack[-1], j + 2))
            if w[stack[-1]] == x:
                stack.pop()
        stack.append(j)
    return sorted(out)


def sparse_all(data: bytes) -> list[bytes]:
    """The different sparse grams of a text."""
    return sorted({data[a:b] for a, b in sparse_spans(data)})


def sparse_covering(data: bytes) -> list[bytes]:
    """The fewest sparse grams of a literal that hold each of its byte pairs.

    A span is sparse by the bytes inside it alone, so every text that contains the literal has these grams as well, whatever
    ties there are between weights.
    """
    reach: dict[int, int] = {}
    for a, b in sparse_spans(data):
        reach[a] = max(reach.get(a, 0), b)
    out, at, best = set(), 0, (0, 0)
    for pair in range(len(data) - 1):
        best = max(best, (reach.get(pair, 0), -pair))
        if pair >= at:  # the pair is not covered yet
            end, start = best[0], -best[1]
            out.add(data[start:end])
            at = end - 1
    return sorted(out)


def _nexts(w: np.ndarray, near: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the next one that is as heavy, if it is at most ``near`` away, else -1; and the pairs without one so near."""
    n = len(w)
    padded = np.append(w, np.full(near, HEAVIEST, w.dtype))
    out, left = np.full(n, -1, np.int64), np.flatnonzero(w < HEAVIEST)
    for d in range(1, near + 1):
        met = padded[left + d] >= w[left]
        out[left[met]] = left[met] + d
        left = left[~met]
    return out, left


def _far(w: np.ndarray, seekers: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    """The next pairs of the few seekers; they are among ``ends``, as what lies near before such a pair is lighter."""
    stack: list[int] = []
    places = np.concatenate([ends, seekers])
    kinds = np.repeat([0, 1], [len(ends), len(seekers)])
    order = np.lexsort((kinds, places))
    for at, seeks, x in zip(places[order].tolist(), kinds[order].tolist(), w[places[order]].tolist(), strict=True):
        if seeks:
            stack.append(at)
        else:
            while stack and w[stack[-1]] <= x:
                out[stack.pop()] = at


#: More than the weight of any pair; stands between texts.
HEAVIEST = 1 << 16


def spans_between(data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sparse_spans`` of many texts that lie one after the other in ``data``, as starts and ends; ``last`` has the place of
    each text's last byte. Two pairs make a span if one is the next or previous one that is as heavy as the other. A span can
    come twice."""
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = data.astype(np.int64)
    w = np.append(weights()[b[:-1] << 8 | b[1:]], HEAVIEST).astype(np.int32)
    w[last[last >= 0]] = HEAVIEST
    after, seek_after = _nexts(w)
    before, seek_before = _nexts(w[::-1])
    n, walls = len(w), np.flatnonzero(w == HEAVIEST)
    seek_before = n - 1 - seek_before[::-1]
    _far(w, seek_after, np.union1d(seek_before, walls), after)
    mirrored = lambda x: n - 1 - x[::-1]
    _far(w[::-1], mirrored(seek_before), mirrored(np.union1d(seek_after, walls)), before)
    before = np.where(before[::-1] >= 0, n - 1 - before[::-1], -1)
    inner = np.flatnonzero(w < HEAVIEST)
    up, down = inner[after[inner] >= 0], inner[before[inner] >= 0]
    up, down = up[w[after[up]] < HEAVIEST], down[w[before[down]] < HEAVIEST]
    # pairs side by side come as next or as previous ones; those of equal weight as both
    return np.concatenate([inner, up, before[down]]), np.concatenate([inner + 2, after[up] + 2, down + 2])


def different(key: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorts in place."""
    key.sort()
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _trigram_pairs(data: np.ndarray, text: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    b = data.astype(np.int64)
    inside = text[:-2] == text[2:]
    key = different((b[:-2] << 16 | b[1:-1] << 8 | b[2:])[inside] << 32 | text[:-2][inside])
    packed, of = key >> 32, key & 0xFFFFFFFF
    fresh = np.append(True, packed[1:] != packed[:-1])[: len(packed)]
    some = packed[fresh]
    raw = np.stack([some >> 16, some >> 8 & 255, some & 255], axis=1).astype(np.uint8).tobytes()
    grams = pa.Array.from_buffers(pa.binary(3), len(some), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return grams, np.cumsum(fresh) - 1, of


def _sparse_pairs(data: np.ndarray, text: np.ndarray, last: np.ndarray, step: int = 1 << 21) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    start, end = spans_between(data, last)
    names, codes, of = [pa.array([], pa.binary())], [], []
    for i in range(0, len(start), step):
        a, size = start[i : i + step], (end - start)[i : i + step]
        order = np.argsort(size.astype(np.uint16) if size.max() < 1 << 16 else size, kind="stable")
        a, size = a[order], size[order]
        cut = np.append(np.flatnonzero(np.append(True, size[1:] != size[:-1])), len(size))
        raw = b"".join(np.lib.stride_tricks.sliding_window_view(data, int(size[x]))[a[x:y]].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True))
        offsets = np.append(0, np.cumsum(size))
        grams = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        key = different(grams.indices.to_numpy().astype(np.int64) << 32 | text[a])
        codes.append((key >> 32) + sum(map(len, names)))
        of.append(key & 0xFFFFFFFF)
        names.append(grams.dictionary.cast(pa.binary()))
    if len(codes) == 1:
        return names[1], codes[0], of[0]
    every = pa.concat_arrays(names).dictionary_encode()
    codes = every.indices.to_numpy()[np.concatenate(codes)] if codes else np.zeros(0, np.int64)
    key = different(codes.astype(np.int64) << 32 | (np.concatenate(of) if of else 0))
    return every.dictionary, key >> 32, key & 0xFFFFFFFF


def gram_pairs(ids: np.ndarray, texts: pa.Array, sparse: bool, step: int = 1 << 19) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The grams of texts, each once a text, as (grams, place in grams, id of the text); a text is whole in one of the parts."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, "right")) - 1)
        part = data[bounds[i] : bounds[j]]
        text = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
        if len(part) >= (2 if sparse else 3):
            grams, codes, of = _sparse_pairs(part, text, bounds[i + 1 : j + 1] - bounds[i] - 1) if sparse else _trigram_pairs(part, text)
            yield grams, codes, ids[i:j][of]
        i = j


def texts_of(df: DataFrame, file_id: str, content: str) -> DataFrame:
    return df.select(F.col(file_id).cast("long").alias("file_id"), F.col(content).cast("binary").alias("content")).filter("file_id IS NOT NULL")


def explode_grams(df: DataFrame, file_id: str, content: str, sparse: bool = False, only: list[bytes] | None = None) -> DataFrame:
    """(file_id, gram): the different byte grams of each file, or those among ``only``, from Arrow batches by NumPy."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, codes, ids in gram_pairs(batch.column(0).to_numpy(), batch.column(1), sparse):
                if only is not None:
                    met = pc.is_in(grams, value_set=pa.array(only, pa.binary())).to_numpy(zero_copy_only=False)[codes]
                    codes, ids = codes[met], ids[met]
                for i in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), grams.take(pa.array(codes[i : i + (1 << 16)]))], names=["file_id", "gram"])

    return texts_of(df, file_id, content).mapInArrow(run, "file_id long, gram binary")
