"""Sharding by a two-pass external shuffle.

The first pass scatters the records by seeded hashes: the id picks the shard by highest random weight, so that one shard
more takes records only into itself, and a second hash of id and text picks one of the shard's buckets, of which there are
so many that a bucket fits in memory. The second pass gives the records of each bucket, in a fixed order, the places of a
Fisher-Yates permutation seeded by shard and bucket; the places of a shard run on from bucket to bucket.

Only places are held in memory, never texts: a bucket costs 8 bytes a record, so even records equal in all columns, which
no hash can part, pass through one task as a stream. Results don't depend on the order or partitioning of the input, up to
which of several equal records takes which of their places.

Defined results: a null text counts no bytes and has the checksum of none; all null ids share a shard; repeated rows each
get a place; empty tables give empty tables. Columns named as the operator's output are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramsieve.llm.common import without
from gramsieve.shipping import ship

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 32 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash of key and shard: a new shard can only win records, never move them among the others."""
    weights = F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("w"), F.lit(i).alias("i")) for i in range(shards)])
    return F.array_max(weights)["i"]


def assign(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``shard``, ``bucket``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (with one shard more)."""
    df = without(df, ["shard", "bucket", "slot", "grown_shard", "__b", "__h", "__n", "__from", "__s"])
    ship(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("string"))), F.count("*")).head()
    buckets = max(1, -(-((total[0] or 0) + 8 * total[1]) // (shards * bucket_bytes)))
    key = F.col(doc_id)
    dealt = df.withColumn("__h", F.xxhash64(F.lit(seed), key, F.col(text)))
    dealt = dealt.withColumns({"shard": shard_of(key, shards, seed), "__b": F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(buckets)).cast("int")})
    counts = dealt.groupBy(F.col("shard").alias("__s"), F.col("__b").alias("bucket")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    met = dealt.repartition("shard", "__b").join(counts, (F.col("shard") == F.col("__s")) & (F.col("__b") == F.col("bucket")), "inner").drop("__s", "__b")
    met = met.sortWithinPartitions("shard", "bucket", "__h", doc_id)
    names = met.columns
    schema = T.StructType([*met.schema.fields, T.StructField("slot", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, at = None, None, 0
        for batch in batches:
            shard, bucket, n, start = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "bucket", "__n", "__from"))
            slots = np.empty(len(shard), np.int64)
            edges = np.flatnonzero(np.diff(shard) | np.diff(bucket)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
                if a == b:
                    continue
                if now != (shard[a], bucket[a]):
                    now, at = (shard[a], bucket[a]), 0
                    places = np.random.default_rng([seed, int(shard[a]), int(bucket[a])]).permutation(int(n[a]))
                slots[a:b] = start[a] + places[at : at + b - a]
                at += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots)], names=[*names, "slot"])

    out = met.mapInArrow(run, schema).drop("__h", "__n", "__from")
    return out.withColumn("grown_shard", shard_of(key, shards + 1, seed))


def write(assigned: DataFrame, path: str) -> None:
    """Writes each shard to its own folder; a bucket's records stand in the order of their places."""
    assigned.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").parquet(path)
