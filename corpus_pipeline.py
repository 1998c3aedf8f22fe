"""Pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, mixing by source and tokens.

Each stage's result is written as Parquet to the shared folder and reread as the next one's input, so a lost executor costs
tasks of one stage. Null and empty texts have no words and go with the quality rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.llm import bpe, linededup, lshforest, mixing, quality
from gramsieve.llm.queries import rank_path
from gramsieve.places import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality.judge(quality.ledger(docs), "v1").filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that recur in earlier documents; a document of which no line is left goes."""
    out = linededup.drop_recurring(docs).filter("n_dropped < n_lines OR n_lines = 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and of lines of over 50 words that several of these hold one copy.

    A document of which no word is left goes. Passages come last, so that near duplicates are told by their whole texts.
    """
    out = linededup.drop_passages(lshforest.keep_one(docs).select(*docs.columns))
    kept = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its bytes."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "lang", "text"), rank_path()), rank_path())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]
#: Hash draws, signatures and merges aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes when the next one's is complete, the last one's with the driver."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    remove(spark, before, at_exit=True)
    return docs
