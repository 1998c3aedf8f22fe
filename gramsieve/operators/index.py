"""The n-gram inverted index as tables: grams with their files, looked up by set operations.

Postings are written in blocks: a row holds a gram's files among those that one task met, at most ``PAIRS`` of them, as
differences. A task packs its own files and sorts its blocks by gram, so nothing but the texts is dealt out, a lookup prunes
row groups in each task's file, and a frequent gram is never gathered into one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramsieve.functions.grams import different, explode_grams, gram_pairs, texts_of
from gramsieve.operators.search import find_matches, matching_files, scan_stats
from gramsieve.plans import literals as L
from gramsieve.plans.planner import Override, Plan, by_frequency, plan
from gramsieve.shipping import ship

#: Since version 4 postings are in blocks.
VERSION, FIRST_BLOCKS = 4, 4
#: A block: ``n`` files of a gram, the first and the differences to the next ones.
BLOCK = "gram binary, first long, n long, data binary"
#: How many postings a task holds before it packs them, and how many it unpacks at once.
PAIRS, UNPACKED = 1 << 22, 1 << 18
#: Bytes of a table, as Spark's statistics have them, that one task of a build takes (fixed value).
DEALT = 16 << 20


class IndexError_(Exception):
    """The index can't be opened."""


def postings_of(files: DataFrame, file_id: str = "file_id", content: str = "text", sparse: bool = True, only: list[bytes] | None = None) -> DataFrame:
    """(gram, file_id), each once; of all grams or of a few. Sparse grams hold all trigrams, as nothing lies between two pairs side by side, so both
    strategies find their grams among them."""
    return explode_grams(files, file_id, content, sparse, only)


def number_files(corpus: DataFrame, path: str = "path", ranges: int | None = None) -> DataFrame:
    """Adds dense ids from 0 in order of path; rows of one path are numbered next to each other, by their other columns' hash.

    Paths are dealt over ranges between bounds from a sample. The range of a path follows from its name alone, so counts and
    places agree however often and wherever Spark plans them; a range is numbered by one task, and ``ranges`` (the session's
    shuffle partitions) grows with the cluster. Rows without a path come first.
    """
    spark = corpus.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = F.col(path).cast("string")
    # a bounded sample, by hash, as a few names a range are enough
    sample = corpus.select(p.alias("p")).filter("p IS NOT NULL").distinct().orderBy(F.xxhash64("p"), "p").limit(20 * ranges).collect()
    sample = sorted((r.p for r in sample), key=str.encode)
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}, key=str.encode) if sample else []
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= p)) if bounds else F.lit(0)
    dealt = corpus.withColumn("__r", F.when(p.isNull(), -1).otherwise(at))
    counts, before, total = {r["__r"]: r["n"] for r in dealt.groupBy("__r").agg(F.count("*").alias("n")).collect()}, [], 0
    for r in sorted(counts):
        before += [F.lit(r), F.lit(total)]
        total += counts[r]
    within = W.partitionBy("__r").orderBy(p, F.xxhash64(*corpus.columns))
    start = F.create_map(*before)[F.col("__r")] if before else F.lit(0)
    return dealt.withColumn("file_id", (F.row_number().over(within) - 1 + start).cast("long")).drop("__r")


def files_of(files: DataFrame, file_id: str = "file_id", path: str = "path", content: str = "text") -> DataFrame:
    """(file_id, path, n_bytes, hash): an index's table of files."""
    return files.select(F.col(file_id).cast("long").alias("file_id"), F.col(path).cast("string").alias("path"), F.octet_length(content).cast("long").alias("n_bytes"), F.xxhash64(content).alias("hash"))


def build(files: DataFrame, target: str, file_id: str = "file_id", path: str = "path", content: str = "text", base: str | None = None, sparse: bool = True) -> None:
    """Writes files, postings, grams and a manifest under ``target``."""
    _write(files_of(files, file_id, path, content), blocks_of(files, file_id, content, sparse), target, sparse, base)


def write(files: DataFrame, postings: DataFrame, target: str, sparse: bool, base: str | None = None) -> None:
    """The same from postings (gram, file_id)."""
    _write(files, pack(postings), target, sparse, base)


def _write(files: DataFrame, blocks: DataFrame, target: str, sparse: bool, base: str | None) -> None:
    spark = files.sparkSession
    files.write.mode("overwrite").parquet(f"{target}/files")
    blocks.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{target}/postings")
    saved = spark.read.schema(BLOCK).parquet(f"{target}/postings")
    grams = saved.groupBy("gram").agg(F.sum("n").alias("df")).withColumn("is_sparse", F.lit(sparse))
    grams.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{target}/grams")
    counts = spark.read.parquet(f"{target}/files").agg(F.count("*").alias("file_count"), F.sum("n_bytes").alias("source_bytes"), _checksum("file_id", "path", "n_bytes").alias("files_checksum"))
    sums = spark.read.parquet(f"{target}/grams").agg(F.count("*").alias("ngram_count"), F.sum("df").alias("posting_count"), _checksum("gram", "df").alias("checksum"))
    lists = saved.agg(_checksum("gram", "first", "n", "data").alias("postings_checksum"))
    counts.join(sums).join(lists).select(F.lit(VERSION).alias("version"), F.lit(sparse).alias("sparse"), "*", F.lit(base).cast("string").alias("base_commit")).write.mode("overwrite").parquet(f"{target}/manifest")


def _packed(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings given as (grams, place in grams, file ids)."""
    names = pa.concat_arrays([g for g, _, _ in parts]).dictionary_encode()
    shift = np.cumsum([0, *(len(g) for g, _, _ in parts)])
    codes = names.indices.to_numpy()[np.concatenate([c + k for (_, c, _), k in zip(parts, shift, strict=False)])]
    files, rank = np.unique(np.concatenate([i for _, _, i in parts]), return_inverse=True)
    key = different(codes.astype(np.int64) << 32 | rank)
    codes, ids = key >> 32, files[key & 0xFFFFFFFF]
    head = np.append(True, codes[1:] != codes[:-1])
    at = np.flatnonzero(head)
    gaps = np.diff(ids, prepend=0).view(np.uint64)
    size = np.where(head, 0, 1 + sum((gaps >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10)))
    end = np.cumsum(size)
    data = np.zeros(int(end[-1]), np.uint8)
    for k in range(int(size.max())):
        some = size > k
        low = (gaps[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        data[(end - size)[some] + k] = low | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    bounds = np.append((end - size)[at], end[-1]).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    out = pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(codes[at])), pa.array(ids[at]), pa.array(np.diff(np.append(at, len(codes)))), lists], names=["gram", "first", "n", "data"])
    for i in range(0, len(at), 1 << 16):
        yield out.slice(i, 1 << 16)


def _in_blocks(parts: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], most: int = PAIRS) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        if len(part[1]):
            held.append(part)
            n += len(part[1])
        if n >= most:
            yield from _packed(held)
            held, n = [], 0
    if held:
        yield from _packed(held)


def blocks_of(files: DataFrame, file_id: str = "file_id", content: str = "text", sparse: bool = True) -> DataFrame:
    """Blocks of the grams of files. Texts are dealt over tasks first, as a table can lie in a few row groups: over three for
    each core, so that they end together, and over one for each ``DEALT`` bytes, as far as the session's shuffle partitions."""
    spark = files.sparkSession
    ship(spark)
    texts = texts_of(files, file_id, content)
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(3 * spark.sparkContext.defaultParallelism, min(size // DEALT, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_blocks(part for b in batches for part in gram_pairs(b.column(0).to_numpy(), b.column(1), sparse))

    return texts.repartition(tasks, "file_id").mapInArrow(run, BLOCK)


def pack(postings: DataFrame, most: int = PAIRS) -> DataFrame:
    """Blocks of postings (gram, file_id), where they lie."""
    ship(postings.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for b in batches:
            grams = b.column(0).dictionary_encode()
            yield grams.dictionary, grams.indices.to_numpy(), b.column(1).to_numpy()

    return postings.select("gram", "file_id").mapInArrow(lambda batches: _in_blocks(parts(batches), most), BLOCK)


def unpack(blocks: DataFrame, at_once: int = UNPACKED) -> DataFrame:
    """(gram, file_id) of blocks."""
    ship(blocks.sparkSession)

    def ids_of(first: np.ndarray, n: np.ndarray, data: np.ndarray) -> np.ndarray:
        b = data.astype(np.uint64)
        last = np.flatnonzero(b < 128)
        begin = np.append(0, last[:-1] + 1)[: len(last)]
        place = np.arange(len(b)) - np.repeat(begin, last - begin + 1)
        gaps = np.add.reduceat((b & np.uint64(127)) << (7 * place).astype(np.uint64), begin).view(np.int64) if len(b) else np.zeros(0, np.int64)
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int64)
        follows = np.ones(len(out), bool)
        follows[at] = False
        out[follows] = gaps
        run = np.cumsum(out)
        return run - np.repeat(run[at] - first, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, n, lists = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).cast(pa.large_binary())
            bounds = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
            held = lists.buffers()[2]
            data, so_far, i = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), np.cumsum(n), 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(so_far, so_far[i] - n[i] + at_once, "right")))
                ids = ids_of(first[i:j], n[i:j], data[bounds[i] : bounds[j]])
                grams = pa.array(np.repeat(np.arange(i, j), n[i:j]))
                for k in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(grams[k : k + (1 << 16)]), pa.array(ids[k : k + (1 << 16)])], names=["gram", "file_id"])
                i = j

    return blocks.select("gram", "first", "n", "data").mapInArrow(run, "gram binary, file_id long")


def _checksum(*columns: str) -> Column:
    """A checksum of rows in any order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def _among(grams: list[bytes]) -> Column:
    return F.col("gram").isin([bytearray(g) for g in grams])


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Puts a complete index in the place of another."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    fs.rename(path(source), path(target))


class Index:
    """Tables of an index: files, postings, grams. Without sparse grams every plan is a trigram plan.

    ``of_grams`` gives the postings of some grams, where that takes less than a filter of all postings.
    """

    def __init__(self, files: DataFrame, postings: DataFrame, grams: DataFrame | None = None, sparse: bool = False, of_grams: Callable[[list[bytes]], DataFrame] | None = None):
        self.files, self.postings, self.sparse = files, postings, sparse
        self.of_grams = of_grams or (lambda some: postings.filter(_among(some)))
        self.saved = grams is not None
        self.grams = postings.groupBy("gram").agg(F.count("*").alias("df")).withColumn("is_sparse", F.lit(sparse)) if grams is None else grams

    @classmethod
    def open(cls, spark: SparkSession, target: str, check: bool = True) -> Index:
        """Checks the version, and with ``check`` the counts and checksums of all tables against the manifest, which reads them."""
        manifest = spark.read.parquet(f"{target}/manifest").head()
        if manifest is None or manifest["version"] > VERSION:
            raise IndexError_(f"{target}: version {manifest and manifest['version']}; this code reads up to {VERSION}")
        files, lists, grams = (spark.read.parquet(f"{target}/{t}") for t in ("files", "postings", "grams"))
        in_blocks = manifest["version"] >= FIRST_BLOCKS
        if set(lists.columns) != ({"gram", "first", "n", "data"} if in_blocks else {"gram", "file_id"}):
            raise IndexError_(f"{target}: the posting table does not match the manifest")
        out = cls(files, unpack(lists), grams, manifest["sparse"], lambda some: unpack(lists.filter(_among(some)))) if in_blocks else cls(files, lists, grams, manifest["sparse"])
        if check:
            seen = {
                "gram": (out.grams.agg(F.count("*"), _checksum("gram", "df")), ("ngram_count", "checksum")),
                "file": (out.files.agg(F.count("*"), _checksum("file_id", "path", "n_bytes")), ("file_count", "files_checksum")),
                "posting": (lists.agg(F.coalesce(F.sum("n"), F.lit(0)), _checksum("gram", "first", "n", "data")) if in_blocks else lists.agg(F.count("*"), _checksum("gram", "file_id")), ("posting_count", "postings_checksum")),
            }
            for name, (sums, keys) in seen.items():
                if tuple(sums.head()) != tuple(manifest[k] or 0 if k.endswith("count") else manifest[k] for k in keys):
                    raise IndexError_(f"{target}: the {name} table does not match the manifest")
        return out

    def lookup(self, grams: list[bytes]) -> DataFrame:
        """(gram, file_id) of some grams; an unknown gram has none."""
        return self.of_grams(grams) if grams else self.postings.limit(0)

    def path_of(self, ids: DataFrame) -> DataFrame:
        """(file_id, path) of some ids; an unknown one has none."""
        return self.files.select("file_id", "path").join(ids.select("file_id"), "file_id", "left_semi")

    def frequencies(self, grams: list[bytes]) -> dict[bytes, int]:
        """In how many files each of a pattern's grams is; a few rows of the gram table."""
        if not grams:
            return {}
        some = self.grams.filter(_among(grams)).select("gram", "df") if self.saved else self.lookup(grams).groupBy("gram").agg(F.count("*").alias("df"))
        return {bytes(r["gram"]): r["df"] for r in some.collect()}

    def contains(self, gram: bytes) -> bool:
        return not self.lookup([gram]).isEmpty()

    def all_of(self, grams: list[bytes]) -> DataFrame:
        """Files that hold all grams; without grams all files."""
        grams = list(dict.fromkeys(grams))
        if not grams:
            return self.files.select("file_id")
        return self.lookup(grams).groupBy("file_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("file_id")

    def any_of(self, grams: list[bytes]) -> DataFrame:
        """Files that hold one of the grams; without grams none."""
        return self.lookup(grams).select("file_id").distinct()

    def candidates(self, chosen: Plan) -> DataFrame:
        """Files that the plan's tree of grams admits: one lookup, one aggregation, one condition."""
        if chosen.tree is None:
            return self.files.select("file_id")
        names = {g: f"g{i}" for i, g in enumerate(chosen.grams)}
        flags = [F.max(F.col("gram") == F.lit(bytearray(g))).alias(n) for g, n in names.items()]
        held = self.lookup(list(chosen.grams)).groupBy("file_id").agg(*flags)
        return held.filter(L.holds(chosen.tree, lambda g: F.col(names[g]))).select("file_id")

    def plan(self, pattern: str, override: Override = Override.AUTO) -> Plan:
        """The plan that is cheapest by the files that hold its grams; unless it is forced, both strategies' grams are looked up."""
        override = override if self.sparse else Override.TRIGRAM
        if override is not Override.AUTO:
            return plan(pattern, override)
        grams = {g for o in (Override.TRIGRAM, Override.SPARSE) for g in plan(pattern, o).grams}
        if not grams:
            return plan(pattern, override)
        return plan(pattern, override, by_frequency(self.frequencies(sorted(grams)), self.files.count(), absent=0.0))

    def counts(self) -> DataFrame:
        """One row: files, their bytes, grams, those that the sparse extractor gives and those of the trigram extractor alone."""
        files = self.files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("source_bytes"))
        grams = self.grams.agg(F.count("*").alias("ngram_count"), F.count_if("is_sparse").alias("sparse_count"), F.count_if(~F.col("is_sparse")).alias("trigram_only_count"))
        return files.join(grams)

    def stats(self) -> DataFrame:
        """Gram counts by kind and the distribution of list sizes: nearest rank, floored; zeros if empty."""
        g = self.grams
        n = F.count("*")
        rank = W.orderBy("df")
        # distinct sizes with their counts are few; ranks come from running sums over them
        sizes = g.groupBy("df").agg(n.alias("c")).withColumn("to", F.sum("c").over(rank)).withColumn("all", F.sum("c").over(W.partitionBy(F.lit(1))))

        def at(position: Column) -> Column:
            return F.coalesce(F.min(F.when(F.col("to") > position, F.col("df"))), F.lit(0)).cast("long")

        all_ = F.col("all")
        return sizes.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("ngram_count"),
            F.coalesce(F.sum(F.col("df") * F.col("c")) / F.sum("c"), F.lit(0.0)).alias("mean_df"),
            at(F.floor(all_ / 2)).alias("median_df"),
            at(F.floor((all_ - 1) * 95 / 100)).alias("p95_df"),
            at(F.floor((all_ - 1) * 99 / 100)).alias("p99_df"),
            F.coalesce(F.max("df"), F.lit(0)).cast("long").alias("max_df"),
            F.coalesce(F.sum(F.when(F.col("df") > 1000, F.col("c"))), F.lit(0)).alias("over_1000"),
            F.coalesce(F.sum(F.when(F.col("df") > 10000, F.col("c"))), F.lit(0)).alias("over_10000"),
        )

    def search(self, corpus: DataFrame, pattern: str, override: Override = Override.AUTO, file_id: str = "file_id", path: str = "path", text: str = "text") -> DataFrame:
        """The matches of a scan, read from candidate files only."""
        chosen = self.plan(pattern, override)
        if chosen.tree is None:
            return find_matches(corpus, pattern, path, text)
        ids = self.candidates(chosen).withColumnRenamed("file_id", "__f")
        return find_matches(corpus.join(ids, corpus[file_id] == F.col("__f"), "left_semi"), pattern, path, text)

    def search_files(self, corpus: DataFrame, pattern: str, override: Override = Override.AUTO, file_id: str = "file_id", path: str = "path", text: str = "text") -> DataFrame:
        chosen = self.plan(pattern, override)
        ids = self.candidates(chosen).withColumnRenamed("file_id", "__f")
        return matching_files(corpus.join(ids, corpus[file_id] == F.col("__f"), "left_semi"), pattern, path, text)


    def search_counted(self, corpus: DataFrame, pattern: str, override: Override = Override.AUTO, file_id: str = "file_id", text: str = "text") -> DataFrame:
        """One row about a search: strategy, lookups, all files, candidates, their bytes, files that match, matches, and the
        seconds that planning took and that the row took to make."""
        began = time.perf_counter()
        chosen = self.plan(pattern, override)
        planned = time.perf_counter() - began
        ids = self.candidates(chosen).withColumnRenamed("file_id", "__f")
        met = corpus.join(ids, corpus[file_id] == F.col("__f"), "left_semi")
        counted = scan_stats(met, pattern, text=text).head()
        row = (str(chosen.strategy), chosen.lookups, self.files.count(), counted["files_scanned"], counted["bytes_scanned"] or 0, counted["files_matched"], counted["matches"] or 0, planned, time.perf_counter() - began)
        return corpus.sparkSession.createDataFrame([row], "strategy string, lookups long, files long, candidates long, bytes_read long, files_matched long, matches long, plan_seconds double, seconds double")


def varint_length(x: Column) -> Column:
    """Bytes of a number in groups of 7 bits."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5)


def posting_sizes(postings: DataFrame) -> DataFrame:
    """Per gram: files, bytes as fixed and as variable-length deltas (tag and count included), and as a bitmap's buckets."""
    before = F.lag("file_id", 1, 0).over(W.partitionBy("gram").orderBy("file_id"))
    gaps = postings.withColumn("gap", F.col("file_id") - before)
    n = F.count("*")
    return gaps.groupBy("gram").agg(
        n.alias("df"), (5 + 4 * n).cast("long").alias("fixed_bytes"), (1 + varint_length(n) + F.sum(varint_length(F.col("gap")))).cast("long").alias("varint_bytes"), F.count_distinct(F.bitmap_bucket_number(F.col("file_id") + 1)).alias("buckets")
    )


#: Forms of an encoded list: differences of 4 bytes, differences of 7 bits a byte, a bitmap.
FIXED, VARINT, BITMAP = 1, 2, 3


def _varints(gaps: np.ndarray) -> bytes:
    """Numbers of up to 35 bits, low groups of 7 bits first; all but a number's last byte have the high bit."""
    groups = (gaps[:, None] >> np.arange(0, 35, 7)) & 127
    n = np.maximum(1, (gaps[:, None] >= (1 << np.arange(0, 35, 7))).sum(axis=1))
    place = np.arange(5)
    return (groups | np.where(place < n[:, None] - 1, 128, 0))[place < n[:, None]].astype(np.uint8).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    start = np.append(0, last[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((b & 127) << (7 * place), start) if len(b) else np.zeros(0, np.int64)


def encode_postings(postings: DataFrame, form: int | None = None) -> DataFrame:
    """(gram, bucket, n, data): lists of files in blocks of 32 768 ids, as a tag of one byte and a body in the given form, or in
    the shortest. A block is of bounded size however frequent its gram is."""
    span = 1 << 15

    def body(ids: np.ndarray, kind: int) -> bytes:
        gaps = np.diff(ids, prepend=0)
        if kind == FIXED:
            return bytes([FIXED]) + gaps.astype("<u4").tobytes()
        if kind == VARINT:
            return bytes([VARINT]) + _varints(gaps)
        bits = np.zeros(span, np.uint8)
        bits[ids] = 1
        return bytes([BITMAP]) + np.packbits(bits, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
            data = [body(x, form) if form else min((body(x, k) for k in (VARINT, BITMAP)), key=len) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array(data, pa.binary())], names=["gram", "bucket", "n", "data"])

    place = F.pmod("file_id", F.lit(span)).alias("place")
    blocks = postings.select("gram", F.floor(F.col("file_id") / span).alias("bucket"), place).groupBy("gram", "bucket").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return blocks.mapInArrow(run, "gram binary, bucket long, n long, data binary")


def decode_postings(blocks: DataFrame) -> DataFrame:
    """(gram, file_id) of encoded blocks; an empty block or one with an unknown tag holds nothing."""

    def places(data: bytes) -> np.ndarray:
        kind, rest = data[:1], data[1:]
        if kind == bytes([FIXED]):
            return np.cumsum(np.frombuffer(rest[: len(rest) // 4 * 4], "<u4").astype(np.int64))
        if kind == bytes([VARINT]):
            return np.cumsum(_numbers(rest))
        if kind == bytes([BITMAP]):
            return np.flatnonzero(np.unpackbits(np.frombuffer(rest, np.uint8), bitorder="little"))
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [places(x or b"") + (b << 15) for x, b in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True)]
                grams = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([grams, pa.array(np.concatenate(found).astype(np.int64))], names=["gram", "file_id"])

    return blocks.select("gram", "bucket", "data").mapInArrow(run, "gram binary, file_id long")


def bitmaps(postings: DataFrame, by: list[str]) -> DataFrame:
    """(…, bucket, bitmap): files as bitmaps of 32 768 ids; ids are moved by one, as buckets count from 1."""
    x = F.col("file_id") + 1
    return postings.groupBy(*by, F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bitmap"))
