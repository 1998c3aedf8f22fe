"""Approximate nearest neighbours by a permutation index.

Pivots are vectors picked from a bounded sample by seeded hash (``PIVOTS`` of them, whatever the table's size). A vector is
represented by its ``PREFIX`` nearest pivots in order; every vector is posted with its rank in the file of each of them. A
search adds up, over the files of the query's own nearest pivots, how much nearer each posted vector is than one that shares
no pivot; that orders vectors by the footrule distance of the two orders, pivots beyond the prefix counting as rank
``PREFIX``. The best ``SHARE`` of every block of the index, at least ``LEAST`` and ties included, are reranked by exact distance.

The index is dealt by a hash of the id into blocks of about ``BLOCK`` vectors, each with inverted files of its own; queries
come to every block, in packs of about 1024, by a product of the two tables' partitions: nothing is broadcast or copied, and
no pair of vectors becomes a row.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; a query's own id is never its neighbour; repeated rows count each as neighbours and ask once; ties go to the smaller
id; with fewer than k candidates all are returned; empty tables give empty results. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramsieve.llm.common import cut
from gramsieve.shipping import ship

PIVOTS, PREFIX, SHARE, LEAST, BLOCK = 256, 64, 0.15, 160, 8192


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.col(vector).cast("array<double>")
    x = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.filter(whole & F.exists("v", lambda c: c != 0))


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, in order."""
    near = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


class _Files:
    """The inverted files of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.x, self.prefix = ids, x, prefix
        order = _orders(x, pivots, prefix)
        row, rank = np.repeat(np.arange(len(x)), order.shape[1]), np.tile(np.arange(order.shape[1]), len(x))
        by = np.argsort(order.ravel(), kind="stable")
        edge = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.files = [(row[by[a:b]], prefix - rank[by[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def search(self, query: int, q: np.ndarray, order: np.ndarray, k: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > best:
            # footrule = constant - 2 * gain
            gain = np.zeros(len(self.ids), np.int32)
            for rank, pivot in enumerate(order):
                rows, value = self.files[pivot]
                gain[rows] += np.minimum(value, self.prefix - rank).astype(np.int32)
            rows = np.flatnonzero(gain >= np.partition(gain, len(gain) - best)[len(gain) - best])
        else:
            rows = np.arange(len(self.ids))
        rows = rows[self.ids[rows] != query]
        far = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        top = np.lexsort((self.ids[rows], far))[:k]
        return self.ids[rows[top]], far[top]


def search(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The k nearest found of each row for which ``is_query`` holds: query_id, rank, vec_id and score (Euclidean distance)."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = df.sparkSession
    ship(spark)
    all_ = usable(df, vec_id, vector)
    lengths = all_.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").head()
    if lengths is None:
        return spark.createDataFrame([], schema)
    all_ = all_.filter(F.size("v") == lengths["n"])
    chosen = all_.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots).collect()
    frame = np.array([r["v"] for r in chosen], np.float64)
    prefix = min(prefix, len(frame))
    blocks = max(1, -(-lengths["c"] // block))

    def packed(x: DataFrame, n: int, salt: int, name: str) -> DataFrame:
        """Vectors of a block in one row, by id; blocks are of bounded size as ids are dealt by hash."""
        rows = x.withColumn(f"{name}b", F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int"))
        return rows.groupBy(f"{name}b").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias(name))

    asked = usable(df.filter(is_query), vec_id, vector).filter(F.size("v") == lengths["n"]).dropDuplicates(["id", "v"])
    n_asked = asked.count()
    packs = max(1, -(-n_asked // 1024))
    # dealt to a number of partitions of their own, so that a partition that a task holds has a few packs
    queries = cut(packed(asked, packs, seed + 2, "q").repartition(packs, "qb"))
    index = cut(packed(all_, blocks, seed + 1, "x"))
    # each task reads its blocks and packs from the tables: copies of the packs, one a block, would grow with the square of
    # the input, and Spark's estimate of their size, which leaves the copies out, would send them through the driver
    met = index.crossJoin(queries.hint("shuffle_replicate_nl")).select("xb", "x", "q")

    def matrix(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        both = rows.values
        ids = both.field("id").to_numpy(zero_copy_only=False)
        return ids, both.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, files = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if block != batch.column(0)[i].as_py():
                    block = batch.column(0)[i].as_py()
                    files = _Files(*matrix(batch.column(1)[i]), frame, prefix)
                best = max(LEAST, int(np.ceil(share * len(files.ids))))
                ids, x = matrix(batch.column(2)[i])
                for query, q, order in zip(ids, x, _orders(x, frame, prefix), strict=True):
                    near, far = files.search(int(query), q, order, k, best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), query)), pa.array(near), pa.array(far)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
