"""Near duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), a MinHash signature and a 128-bit digest of the set. Equal sets
   form a class; only one row a class goes on, so exact copies cost one row however many they are.
2. Each of ``TREES`` orders sorts all classes by its own run of ``LONGEST`` signature values (16 bits of each), lexicographically.
   Neighbours whose longest common prefix has at least ``LEVELS[0]`` values are candidates, in every tree. The order is a range
   partition and sort, so a run of any size is spread over tasks; only the first and last row of each partition meet to close
   the seams.
3. Links that whole sets confirm are joined into components. A region is a run with a common prefix; its depth adapts: the
   least of ``LEVELS`` at which it has at most ``REGION`` rows. Pairs across components of a region are candidates, so they are
   at most ``REGION`` a row and tree, however dense the neighbourhood.
4. What dense neighbourhoods (more than ``REGION`` rows at the first level, of several components) leave open is closed exactly:
   of two sets that can link, the rarest shingles, as many as they may differ by and one more, must meet. Shingles are ranked by
   the open classes that hold them; those held by one class come first and meet nobody, so that most rows of a dense group are
   shown to have no further partner without a single pair. Pairs whose sizes and places allow a link are confirmed.

A pair with Jaccard similarity 0.8 outside dense neighbourhoods shares no region with probability (1 - 0.8**4) ** 28, 3e-7.
Signatures only rule out pairs whose agreement is ``SLACK`` below the threshold, five standard deviations.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component; with
fewer words than a shingle the sequence is one shingle. ``component`` is the smallest id reachable; null ids come last, and
a component of null ids alone has none. Repeated rows share a class and so a component. Empty tables give empty tables.
Other columns aren't returned, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramsieve.llm.common import cut, scratch, without
from gramsieve.llm.components import components
from gramsieve.llm.shingles import shingle_set
from gramsieve.shipping import ship

#: Trees, values by which a tree sorts, depths that a region may have, and rows of a region at most.
TREES, LONGEST, LEVELS, REGION = 28, 12, (4, 6, 9, 12), 32
#: Signature values: a tree starts four after the one before and goes round.
K = 4 * TREES
SLACK = 0.2
#: Step between the classes of set sizes in which the rarest shingles meet, and shingles whose counts are sent to all tasks at most.
RATIO, FREQUENT = 1.1, 1 << 16
_ODD = (np.random.default_rng(7).integers(1, 1 << 62, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets: K values of 32 bits each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), K), np.uint32)
    for j in range(K):
        out[:, j] = np.minimum.reduceat(flat * _ODD[j], starts) >> np.uint64(32)
    return out


def _digest(found: np.ndarray) -> bytes | None:
    """The class of a set: 128 bits of a cryptographic hash, so that even 10**12 different sets hold no false match."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def sketch(df: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, th, n, digest, sig): a hash of the text; the size, digest and signature of its set; both null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                begin, sizes, digests, sigs, sets, rows, held = at, [], [], [], [], [], 0
                while at < batch.num_rows and held < 1 << 17:
                    value = batch.column(2)[at].as_py()
                    found = shingle_set(value.encode() if value else b"", words)
                    sizes.append(len(found))
                    digests.append(_digest(found))
                    sigs.append(None)
                    if len(found):
                        rows.append(len(sizes) - 1)
                        sets.append(found)
                        held += len(found)
                    at += 1
                    if len(sizes) >= 4096:
                        break
                if sets:
                    for i, s in zip(rows, signatures(sets), strict=True):
                        sigs[i] = s.tobytes()
                own = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "th", "n", "digest", "sig"])

    content = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(content).alias("th"), content.alias("text")).mapInArrow(run, "id long, th long, n long, digest binary, sig binary")


#: Bytes of a place in the forest (the tree and LONGEST values) and of its part that neighbours must share.
_PLACE, _HEAD = 1 + 2 * LONGEST, 1 + 2 * LEVELS[0]


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _orders(classes: DataFrame) -> DataFrame:
    """(place, c) a class and tree: the tree and its run of signature values, which binary order sorts lexicographically."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, K)
                high = (sig >> np.uint32(16)).astype(">u2")
                for t in range(TREES):
                    values = np.ascontiguousarray(high[:, [(4 * t + j) % K for j in range(LONGEST)]]).view(np.uint8).reshape(len(sig), -1)
                    yield pa.RecordBatch.from_arrays([_fixed(np.concatenate([np.full((len(sig), 1), t, np.uint8), values], axis=1)), batch.column(0)], names=["place", "c"])

    return classes.select("c", "sig").select("c", "sig").mapInArrow(run, "place binary, c long")


def _neighbours(orders: DataFrame) -> DataFrame:
    """(place, c, before): rows that share their place's head with a row beside them, and the row before them if that is one."""
    kind = pa.schema([("place", pa.binary()), ("c", pa.int64()), ("before", pa.int64()), ("seam", pa.bool_())])

    def rows(place: np.ndarray, c: np.ndarray, before: np.ndarray, alone: np.ndarray, seam: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_fixed(place), pa.array(c), pa.array(before, mask=alone), pa.array(np.full(len(c), seam))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # the last row so far: place, id, the id before it, and whether that is no neighbour
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _PLACE)
            c = batch.column(1).to_numpy()
            if held is not None:
                place, c = np.concatenate([held[0], place]), np.concatenate([held[1], c])
            same = (place[1:, :_HEAD] == place[:-1, :_HEAD]).all(axis=1)
            before, alone = np.concatenate([[0], c[:-1]]), np.concatenate([[True], ~same])
            if held is not None:
                before[:1], alone[:1] = held[2], held[3]
            company = ~alone[:-1] | same
            start = int(first and len(c) > 1)
            if start:  # the first row of the partition
                yield rows(place[:1], c[:1], before[:1], alone[:1], True)
                first = False
            out = np.flatnonzero(company[start:]) + start
            if len(out):
                yield rows(place[out], c[out], before[out], alone[out], False)
            held = place[-1:], c[-1:], before[-1:], alone[-1:]
        if held is not None:
            yield rows(*held, True)

    order = ["place", "c"]
    dealt = orders.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(dealt.mapInArrow(run, "place binary, c long, before long, seam boolean"))
    # two rows a partition at most: the last of one and the first of the next
    w = W.orderBy(*order)
    head = F.substring("place", 1, _HEAD)
    seams = found.filter("seam").withColumns({"ph": F.lag(head).over(w), "pc": F.lag("c").over(w)})
    closed = seams.withColumn("before", F.coalesce("before", F.when(F.col("ph") == head, F.col("pc"))))
    return found.filter("NOT seam").drop("seam").unionByName(closed.select("place", "c", "before"))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _alike(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose sizes or signatures show that they can't reach the threshold."""

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            a = np.frombuffer(b"".join(x.iloc[at : at + 4096]), np.uint32).reshape(-1, K)
            b = np.frombuffer(b"".join(y.iloc[at : at + 4096]), np.uint32).reshape(-1, K)
            out[at : at + len(a)] = (a == b).mean(axis=1)
        return pd.Series(out)

    met = pairs.join(near.select(F.col("c").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su")).hint("merge"), "u")
    met = met.join(near.select(F.col("c").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv")).hint("merge"), "v")
    met = met.filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return met.filter(agreement("su", "sv") >= percent / 100 - SLACK).select("u", "v")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    met = pairs.select("u", "v").join(sets.select(F.col("c").alias("u"), F.col("hashes").alias("su")).hint("merge"), "u")
    met = met.join(sets.select(F.col("c").alias("v"), F.col("hashes").alias("sv")).hint("merge"), "v")
    return met.filter(linked("su", "sv")).select("u", "v")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(c, n, hashes) from (c, digest, text), where the text has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [(c, d, shingle_set((x or "").encode(), words)) for c, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                found = [(c, len(x), x.tobytes()) for c, d, x in found if _digest(x) == d]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["c", "n", "hashes"])

    return texts.mapInArrow(run, "c long, n long, hashes binary")


def _placed_in(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the component of each row's class; a class without links is its own."""
    met = rows.join(parts.select(F.col("node").alias("c"), "component").hint("merge"), "c", "left")
    return met.withColumn("component", F.coalesce("component", "c"))


def _across(found: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs across components in regions of adaptive depth, and the classes of dense neighbourhoods (c, component)."""
    left = _placed_in(parts, found.select("place", "c"))
    pairs, dense = [], None
    for depth in LEVELS:
        left = cut(left.withColumn("key", F.substring("place", 1, 1 + 2 * depth)))
        sizes = left.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", "m")
        many = cut(left.join(sizes.hint("merge"), "key"))
        # at most REGION rows each, so a list of them is of bounded size
        members = many.filter(F.col("m") <= REGION).groupBy("key").agg(F.collect_list(F.struct("c", "component")).alias("l"))
        own = lambda a: F.filter("l", lambda b: (b["c"] < a["c"]) & (b["component"] != a["component"]))
        pairs.append(members.select(F.inline(F.flatten(F.transform("l", lambda a: F.transform(own(a), lambda b: F.struct(*_pair(a["c"], b["c"]))))))))
        left = many.filter(F.col("m") > REGION).select("place", "c", "component")
        if dense is None:
            dense = left.select("c", "component").distinct()
        if left.isEmpty():
            break
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    return every.distinct(), dense


def _closing(open_: DataFrame, percent: int) -> DataFrame:
    """From (c, component, n, hashes): every pair across components that may link, by the rarest shingles of both.

    With an overlap of at least a shingles, the first n - a + 1 of both sets, in any common order, share one. The larger set of
    a pair gives them for each class of sizes that its partner may have, the smaller for its own, and the places of the first
    that they share bound the overlap. The order puts shingles by how many classes hold them; those of which there can be more
    than ``FREQUENT`` count alike, as none, so the table of counts is of bounded size.
    """
    spark = open_.sparkSession

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], names=["token"])

    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    tokens = open_.select("hashes").mapInArrow(unpack, "token long")
    # at most FREQUENT shingles occur as often as that
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= max(2, -(-total // FREQUENT))).collect()
    often = np.array([(r["token"], r["df"]) for r in often], np.int64).reshape(-1, 2)
    often = spark.sparkContext.broadcast(often[np.argsort(often[:, 0])])

    def low(x, y):
        """Least overlap that links sets of x and y shingles."""
        return np.maximum(1, -(-percent * (x + y) // (100 + percent)))

    def size_class(n):
        return np.floor(np.log(n) / np.log(RATIO) + 1e-9).astype(np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, df = often.value[:, 0], often.value[:, 1]
        for batch in batches:
            for c, component, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = np.frombuffer(found, np.int64)
                n = len(t)
                rank = np.zeros(n, np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, t), len(token) - 1)
                    rank = np.where(token[at] == t, df[at], 0)
                t = t[np.lexsort((t, rank))]
                least = -(-percent * n // 100)
                own = int(size_class(n))
                runs = [(own, False, n - int(low(n, n)) + 1)]
                for s in range(int(size_class(max(least, 1))), own + 1):
                    runs.append((s, True, n - int(low(n, max(least, int(RATIO**s)))) + 1))
                size = [r[2] for r in runs]
                columns = [np.concatenate([t[:k] for k in size]), np.repeat([r[0] for r in runs], size), np.repeat([r[1] for r in runs], size), np.concatenate([np.arange(k) for k in size])]
                one = [np.full(sum(size), v, np.int64) for v in (c, component, n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(pa.array, one)], names=["token", "s", "larger", "p", "c", "component", "n"])

    both = cut(open_.select("c", "component", "hashes").mapInArrow(first, "token long, s long, larger boolean, p long, c long, component long, n long"))
    smaller = both.filter("NOT larger").select("token", "s", F.col("c").alias("cy"), F.col("component").alias("ky"), F.col("n").alias("ny"), F.col("p").alias("q"))
    met = both.filter("larger").join(smaller.hint("merge"), ["token", "s"])
    x, y = F.col("n"), F.col("ny")
    bound = 1 + F.least(x - F.col("p") - 1, y - F.col("q") - 1)
    met = met.filter(((y < x) | ((y == x) & (F.col("cy") < F.col("c")))) & (F.col("component") != F.col("ky")) & ((100 + percent) * bound >= percent * (x + y)))
    return met.select(*_pair(F.col("c"), F.col("cy"))).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (its id is the component's)."""
    return _placed(df, doc_id, text, words, percent).drop("th")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group of near duplicates, that with the smallest id; texts without words all stay.

    Rows equal in id and text are one document. If rows of a group share the smallest id, the one with the least text hash stays.
    """
    df = without(df, ["__th", "__kd", "__kt"])
    placed = _placed(df, doc_id, text, words, percent).filter("kept")
    one = placed.filter("n_shingles > 0").groupBy("component_id").agg(F.min("th").alias("__kt")).select(F.col("component_id").alias("__kd"), "__kt")
    one = one.unionByName(placed.filter("n_shingles = 0").select(F.col("doc_id").alias("__kd"), F.col("th").alias("__kt")).distinct())
    keyed = df.withColumn("__th", F.xxhash64(F.col(text).cast("string")))
    met = keyed.join(one.hint("merge"), keyed[doc_id].cast("long").eqNullSafe(F.col("__kd")) & (F.col("__th") == F.col("__kt")))
    return met.dropDuplicates(["__kd", "__kt"]).drop("__th", "__kd", "__kt")


def _placed(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th) as a table; all tables on the way are deleted."""
    with scratch(df.sparkSession):
        return cut(_place(df, doc_id, text, words, percent), keep=True)


def _place(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    ship(df.sparkSession)
    seen = cut(sketch(df, doc_id, text, words))
    classes = seen.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("id").alias("low"), F.min(F.struct("th", "id")).alias("one"))
    # a number for each class; it is fixed as the table is written
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    found = cut(_neighbours(_orders(classes)))
    # only classes with company go on
    near = cut(classes.join(found.select("c").distinct().hint("merge"), "c", "left_semi").select("c", "digest", "n", "sig", "one"))
    content = F.col(text).cast("string")
    texts = df.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(content).alias("__th"), content.alias("__text"))
    some = near.select("c", "digest", F.col("one.th").alias("__h"), F.col("one.id").alias("__i"))
    texts = some.hint("merge").join(texts, (F.col("__h") == F.col("__th")) & F.col("__i").eqNullSafe(F.col("__id"))).select("c", "digest", "__text")
    sets = cut(_sets(texts, words).dropDuplicates(["c"]))

    tried = cut(found.filter("before IS NOT NULL").select(*_pair(F.col("c"), F.col("before"))).distinct())
    links = cut(_confirm(_alike(tried, near, percent), sets, percent))
    parts = components(links)

    def more(pairs: DataFrame) -> None:
        nonlocal links, parts
        new = cut(_confirm(pairs, sets, percent))
        if not new.isEmpty():
            links = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u <> v").unionByName(new)
            parts = components(links)

    pairs, dense = _across(found, parts)
    # pairs already confirmed or refuted are not tried again
    pairs = cut(pairs.join(tried.hint("merge"), ["u", "v"], "left_anti"))
    more(_alike(pairs, near, percent))
    open_ = sets.join(_placed_in(parts, dense.select("c")).hint("merge"), "c")
    pairs = _closing(open_, percent).join(tried.unionByName(pairs).hint("merge"), ["u", "v"], "left_anti")
    more(pairs)

    members = parts.join(classes.select(F.col("c").alias("node"), "low").hint("merge"), "node")
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    tops = members.select("node", "component").join(lowest.hint("merge"), "component").select(F.col("node").alias("c"), "component_id", F.lit(True).alias("linked"))
    named = classes.select("c", "digest", "low").join(tops.hint("merge"), "c", "left")
    named = named.select("digest", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    # a class may hold a third of all rows; its side is split by the adaptive skew join
    out = seen.select("id", "th", "n", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "th")
