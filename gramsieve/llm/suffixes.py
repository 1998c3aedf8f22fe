"""Repeated passages by blockwise suffix sorting with a difference cover.

Suffixes are dealt to buckets by content: of the ``SPAN``-byte string that starts at a position, the 32-byte gram with the
least hash is its anchor, and all starts with the same anchor hash form a bucket. Equal strings have equal anchors, so a
bucket holds every copy of its strings, and buckets whose hash is seen once are dropped before any text moves. A run of
starts with one anchor travels as one piece of text; equal pieces are counted before the shuffle and sorted once.

A task packs whole buckets into blocks of bounded size and sorts one block at a time. Positions get order-preserving ranks
of their first 64 bytes; positions in a difference cover modulo 64 also get ranks of their first ``SPAN`` - 64. Two suffixes
that agree on their first and last 64 bytes are compared through the ranks at the cover positions that lie equally far from
both, which exist for any pair, by three-way partitioning. So no comparison walks along a long repeat, and a block needs a
few integers a byte. Buckets with more than ``MOST`` different pieces don't go to one task; their strings are counted one by
one through a shuffle of digests, with the same result.

Defined results: a null text is empty; strings never cross texts and are judged on the input; a string that starts twice in
one text is repeated; repeated rows repeat each other; ids may be null or equal, as rows are told apart by id and text; empty
tables give empty tables. Other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramsieve.llm.common import cut, salted_lookup, scratch
from gramsieve.shipping import ship

GRAM = 32
#: Bytes of text that a task sorts at once, and different pieces of a bucket that may meet in one task.
BLOCK, MOST = 1 << 20, 20_000
#: A difference cover modulo 64 (fixed values): every distance modulo 64 is a difference of two of them.
PERIOD, COVER = 64, (1, 2, 3, 6, 15, 17, 35, 43, 60)

_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _shifts() -> np.ndarray:
    """For two residues, the least k that takes both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    at = np.arange(PERIOD)
    for k in reversed(range(PERIOD)):
        hit = inside[(at + k) % PERIOD]
        out[np.ix_(hit, hit)] = k
    assert (out >= 0).all()
    return out


_SHIFT = _shifts()


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes."""
    h, n, base = _TABLE[b], 1, 0x9E3779B97F4A7C15
    while n < GRAM:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), 2 * n
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start of each run of ``span``-byte strings with one anchor."""
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, step = [], 1 << 20
    for at in range(0, len(data) - span + 1, step):
        b = np.frombuffer(data, np.uint8)[at : at + step + span - 1]
        h = gram_hashes(b)
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first
        width, n = span - GRAM + 1, 1
        while 2 * n <= width:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        if n < width:
            low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        owner = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        out.append((h[owner[first]].view(np.int64), first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Order-preserving dense ranks of rows of non-negative columns, compared from the first column on."""
    rank = columns[0].astype(np.uint64)
    for c in columns[1:]:
        rank = np.unique(rank << np.uint64(32) | c.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return rank


def repeated_starts(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Which of the starts begin a ``span``-byte string that begins at another of them as well."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(span + 2 * PERIOD, np.uint8)])
    head, size = padded.astype(np.uint64), 1
    while size < PERIOD:  # ranks of the first 2, 4 ... 64 bytes of every position
        m = len(head) - size
        head = _ranks([head[:m], head[size : size + m]])
        size *= 2
    tail = span - PERIOD
    # long strings at cover positions: SPAN - 64 bytes, told by the ranks of 64 bytes that tile them
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    sample = np.flatnonzero(inside[np.arange(min(n + PERIOD, len(head) - tail)) % PERIOD])
    steps = [*range(0, tail - PERIOD, PERIOD), tail - PERIOD]
    long = np.zeros(n + 2 * PERIOD, np.int64)
    long[sample] = _ranks([head[sample + s] for s in steps]).astype(np.int64)
    # bucket sort by the first and last 64 bytes, then long ties by the ranks of the cover
    group = _ranks([head[starts], head[starts + tail]]).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, open_ = group[order], starts[order]
    index, twice = order, np.zeros(len(starts), bool)
    while len(open_):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(first, len(group)))
        keep = np.repeat(size > 1, size)  # alone: told from all others
        group, open_, index = group[keep], open_[keep], index[keep]
        if not len(open_):
            break
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(open_[first + size // 2], size)
        k = _SHIFT[open_ % PERIOD, pivot % PERIOD]
        side = np.sign(long[open_ + k] - long[pivot + k])
        same = side == 0
        which = np.repeat(np.arange(len(first)), size)
        many = np.bincount(which[same], minlength=len(first)) > 1
        twice[index[same & many[which]]] = True
        group, open_, index = (3 * which + side + 1)[~same], open_[~same], index[~same]
        by = np.argsort(group, kind="stable")
        group, open_, index = group[by], open_[by], index[by]
    return twice


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal ones; those that touch become one."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


_SPANS = "array<struct<s:int,e:int>>"


def _sort_blocks(pieces: DataFrame, span: int) -> DataFrame:
    """From (h, pd, piece) in buckets of two or more different pieces: adds ``spans``, what repeats in the piece."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def block(held: list) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        size = np.array([len(p) for _, _, p in held])
        at = np.cumsum(size) - size
        count = size - span + 1
        owner = np.repeat(np.arange(len(held)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
        hit = repeated_starts(text, starts, span)
        owner, starts = owner[hit], starts[hit] - at[owner[hit]]
        out: list[list] = [[] for _ in held]
        if len(owner):
            gap = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(starts) > span)))
            for a, b in zip(gap, np.append(gap[1:], len(owner)) - 1, strict=True):
                out[owner[a]].append({"s": int(starts[a]), "e": int(starts[b]) + span})
        return pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in held], pa.int64()), pa.array([p for _, p, _ in held], pa.binary()), pa.array(out, kind)], names=["h", "pd", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket, bucket_size = [], 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket and bucket[0][0] != row[0]:  # buckets stay whole
                    if held and size + bucket_size > BLOCK:
                        yield block(held)
                        held, size = [], 0
                    held, size, bucket, bucket_size = held + bucket, size + bucket_size, [], 0
                bucket.append(row)
                bucket_size += len(row[2])
        held = held + bucket
        if held:
            yield block(held)

    return pieces.select("h", "pd", "piece").repartition("h").sortWithinPartitions("h", "pd").mapInArrow(run, f"h long, pd binary, spans {_SPANS}")


def _count_strings(pieces: DataFrame, span: int) -> DataFrame:
    """The same for buckets of any size: every string of a piece is counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, pd_, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(piece) - span + 1
                found = [hashlib.blake2b(piece[i : i + span], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([pd_] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(found, pa.binary())], names=["h", "pd", "s", "d"])

    strings = pieces.select("h", "pd", "piece").mapInArrow(run, "h long, pd binary, s int, d binary")
    twice = strings.groupBy("d").agg(F.count("*").alias("c")).filter("c > 1").select("d", F.lit(True).alias("hit"))
    met = salted_lookup(strings, twice, ["d"], F.col("pd")).filter("hit")
    return met.groupBy("h", "pd").agg(F.collect_list(F.struct("s", (F.col("s") + span).alias("e"))).alias("spans"))


def _slices(keyed: DataFrame, places: DataFrame, span: int, whole: bool) -> DataFrame:
    """The pieces of text from start a to the end of the string that starts at b, for places (id, th, h, a, b): with a digest
    of their bytes (id, th, h, a, b, pd), or the bytes (h, pd, piece). Texts meet the list of their places, one row a text."""
    columns = ["h", "a", "b", "pd"] if whole else ["h", "a", "b"]
    listed = places.groupBy("id", "th").agg(F.collect_set(F.struct(*columns)).alias("runs"))
    names = ["h", "pd", "piece"] if whole else ["id", "th", "h", "a", "b", "pd"]
    kinds = [pa.int64(), pa.binary(), pa.binary()] if whole else [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, th, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in found:
                    piece = data[r["a"] : r["b"] + span]
                    rows.append((r["h"], r["pd"], piece) if whole else (i, th, r["h"], r["a"], r["b"], hashlib.blake2b(piece, digest_size=16).digest()))
                    held += len(piece) if whole else 64
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    schema = "h long, pd binary, piece binary" if whole else "id long, th long, h long, a int, b int, pd binary"
    return keyed.join(listed, ["id", "th"]).select("id", "th", "content", "runs").mapInArrow(run, schema)


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 400) -> DataFrame:
    """(doc_id, content, spans): the UTF-8 bytes of each text and the maximal runs [s, e) covered by repeated strings."""
    spark = df.sparkSession
    ship(spark)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(content).alias("th"), content.cast("binary").alias("content"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], [], []]
            for i, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h, a, b = runs(data.as_buffer().to_pybytes(), span)
                if len(h):
                    for c, v in zip(found, (np.full(len(h), -1 if i is None else i), np.full(len(h), th), h, a.astype(np.int32), b.astype(np.int32)), strict=True):
                        c.append(v)
                if len(found[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["id", "th", "h", "a", "b"])
                    found = [[], [], [], [], []]
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["id", "th", "h", "a", "b"])

    # a null id is -1 here; the hash of the text keeps its rows apart from those of a true -1
    with scratch(spark):
        all_ = cut(docs.filter(F.length("content") >= span).mapInArrow(anchors, "id long, th long, h long, a int, b int"))
        twice = all_.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h", F.lit(True).alias("hit"))
        some = salted_lookup(all_, twice, ["h"], F.col("id")).filter("hit").select("id", "th", "h", "a", "b")
        keyed = docs.select(F.coalesce("id", F.lit(-1)).alias("id"), "th", "content")
        # digests of the pieces first; bytes only of one piece of each kind, in buckets with more than one kind
        pieces = cut(_slices(keyed, some, span, False), keep=True)
    kinds = pieces.groupBy("h", "pd").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "a", "b")).alias("one"))
    kinds = cut(kinds, keep=True)
    with scratch(spark):
        buckets = kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
        chosen = cut(kinds.join(buckets, "h").select("h", "pd", "m", "one.*"))
        company = _slices(keyed, chosen.filter(F.col("m") <= MOST), span, True)
        spans = _sort_blocks(company, span)
        if not buckets.filter(F.col("m") > MOST).isEmpty():
            spans = spans.unionByName(_count_strings(_slices(keyed, chosen.filter(F.col("m") > MOST), span, True), span))
        spans = cut(spans.filter(F.size("spans") > 0), keep=True)
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("one.b") - F.col("one.a") + span).alias("e"))).cast(_SPANS)
    spans = kinds.select("h", "pd", F.when(F.col("c") > 1, whole).alias("w")).join(spans, ["h", "pd"], "left")
    spans = spans.select("h", "pd", F.coalesce("w", "spans").alias("spans")).filter(F.size("spans") > 0)
    hits = salted_lookup(pieces.select("id", "th", "h", "a", "pd"), spans, ["h", "pd"], F.col("id")).filter("spans IS NOT NULL")
    hits = hits.select("id", "th", "a", F.inline("spans")).select("id", "th", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"))
    hits = hits.groupBy(F.col("id").alias("__i"), F.col("th").alias("__t")).agg(F.collect_set(F.struct("s", "e")).alias("found"))
    keyed = docs.withColumn("k", F.coalesce("id", F.lit(-1)))
    met = keyed.join(hits, (F.col("k") == F.col("__i")) & (F.col("th") == F.col("__t")), "left").select("id", "content", "found")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            out = []
            for found in batch.column(2):
                if not found.is_valid:
                    out.append([])
                    continue
                s, e = _merge(found.values.field("s").to_numpy(), found.values.field("e").to_numpy())
                out.append([{"s": int(x), "e": int(y)} for x, y in zip(s, e, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "content", "spans"])

    return met.mapInArrow(merge, f"doc_id long, content binary, spans {_SPANS}")


def without_spans(df: DataFrame, content: str = "content", spans: str = "spans", out: str = "kept") -> DataFrame:
    """Adds the bytes outside the spans, concatenated."""
    s, c = F.col(spans), F.col(content)
    starts = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["e"]))
    ends = F.concat(F.transform(s, lambda x: x["s"]), F.array(F.length(c)))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(c, a + 1, b - a))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p))
    return df.withColumn(out, F.when(F.size(s) == 0, c).otherwise(joined))
