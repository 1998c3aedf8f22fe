"""Line dedup by a log-template tree of fixed depth.

A line is parsed to its leaf by the number of its tokens and its ``LEAD`` leading tokens, tokens that hold a digit counting
as variable fields. Within a leaf a token is constant at its place if at least half of the leaf's (document, line) pairs have
it there, else it is a variable field too. Lines whose constants agree share a template, provided that at least ``ALIKE`` of
their tokens are constants that aren't fields, and as large a part of the tokens after the leading ones, which agree throughout
a leaf; other lines are a template of their own. A line with fewer than ``ALIKE`` tokens without a digit is taken as it
stands, so that rows of numbers are equal only if their numbers are. A template that recurs in ``min_docs`` or more documents
is dropped from all but the document with the smallest id; with ``passage`` a line of more words than that goes from the second document
on, if its words are equal up to fields with digits.

All counts are sums by leaf, place and token over hash partitions, so a leaf of any size is spread over tasks, and only
leaves that could reach ``min_docs`` and hold different lines are looked into; other lines travel as hashes. Texts are moved
once, to meet their dropped templates.

Defined results: null and empty texts have no lines and stay; lines without a token are never dropped; rows with the same id
are one document; null ids are one document, which comes last; repeated rows are treated alike; empty tables give empty
tables. Columns named as the operator's output are replaced, the text is rewritten, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramsieve.llm.common import SPACES, cut, salted_lookup, without, words
from gramsieve.shipping import ship

LEAD, ALIKE = 3, 0.6
#: Rows of up to three hashes up to which a table is broadcast: 24 bytes each.
SMALL = 100_000


def _tokens(line: Column) -> Column:
    """Tokens, with variable fields masked where ``ALIKE`` of them are none."""
    field = lambda t: t.rlike("[0-9]")

    def masked(plain: Column) -> Column:
        few = F.size(F.filter(plain, lambda t: ~field(t))) < F.lit(ALIKE) * F.size(plain)
        return F.when(few, plain).otherwise(F.transform(plain, lambda t: F.when(field(t), F.lit("<*>")).otherwise(t)))

    # an array of one, so that the words are split once
    return F.when(field(line), F.element_at(F.transform(F.array(words(line)), masked), 1)).otherwise(words(line))


def _full(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def _hash(tokens: Column) -> Column:
    return F.xxhash64(tokens)


def _near(df: DataFrame, right: DataFrame, keys: list[str], spread: Column, rows: int) -> DataFrame:
    """Left join with a lookup table of known size: broadcast if small, else dealt with salted keys.

    A large one is merged, as Spark's estimate leaves its copies out and might send them all through the driver.
    """
    return df.join(F.broadcast(right), keys, "left") if rows <= SMALL else salted_lookup(df, right, keys, spread, large=True)


def _lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, m, leaf, size, tokens): the different lines of each row."""
    split = F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    x = df.select(F.col(doc_id).cast("long").alias("id"), F.explode(F.filter(split, _full)).alias("x")).select("id", _tokens(F.col("x")).alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEAD))
    return x.select("id", _hash(F.col("tokens")).alias("m"), leaf.alias("leaf"), F.size("tokens").alias("size"), "tokens")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _outside(hashes: pd.Series, gone: pd.Series) -> pd.Series:
    """For each hash of a row whether it is none of the row's second list."""
    return pd.Series([None if g is None else ~np.isin(h, g) for h, g in zip(hashes, gone, strict=True)])


def templates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """The different lines (id, m, size) of all documents; (m, t), the template of lines that share one with others; its rows."""
    lines = _lines(df, doc_id, text)
    held = cut(lines.select("id", "m", "leaf", "size").distinct())
    known = held.groupBy("m", "leaf").agg(F.count("*").alias("c"))
    leaves = known.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("c").alias("all")).filter((F.col("n") > 1) & (F.col("all") >= min_docs))
    some = cut(known.join(leaves.select("leaf", "all"), "leaf").select("m", "c", "all"))
    n = some.count()
    if not n:
        return held, some.select("m", F.col("m").alias("t")), 0
    found = _near(lines, some, ["m"], F.col("id"), n).filter("c IS NOT NULL").dropDuplicates(["m"])
    tokens = cut(found.select("m", "leaf", "c", "all", "size", F.posexplode("tokens").alias("pos", "token")).withColumns({"word": ~F.col("token").rlike("[0-9]|^<\\*>$"), "token": F.xxhash64("token")}))
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("c").alias("w"), F.first("all").alias("all")).filter("2 * w >= all").select("leaf", "pos", "token", F.lit(True).alias("fixed"))
    constant = cut(constant)
    met = _near(tokens, constant, ["leaf", "pos", "token"], F.col("m"), constant.count()).filter("fixed")
    shape = met.groupBy("m", "leaf", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("k"), F.count_if("word").alias("n_words"))
    later = F.size(F.filter("k", lambda c: c["pos"] >= LEAD))
    alike = (F.col("n_words") >= F.lit(ALIKE) * F.col("size")) & (later >= F.lit(ALIKE) * (F.col("size") - LEAD))
    mapped = shape.filter(alike).select("m", F.xxhash64("leaf", "k").alias("t"))
    return held, cut(mapped), n


def _later(held: DataFrame, pairs: DataFrame, key: str, least: int) -> DataFrame:
    """(id, m) of the lines whose key ``least`` or more of the different (id, key) hold, but for the smallest id's."""
    often = pairs.groupBy(key).agg(F.count("*").alias("c"), F.min("id").alias("first")).filter(F.col("c") >= least)
    often = cut(often.select(key, "first", F.lit(True).alias("often")))
    met = _near(held, often, [key], F.col("id"), often.count())
    return met.filter("often").filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "m")


def drop_recurring(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, passage: int | None = None) -> DataFrame:
    """Rewrites ``text`` without recurring lines and adds ``n_lines`` (with a token) and ``n_dropped``."""
    ship(df.sparkSession)
    held, mapped, n = templates(df, doc_id, text, min_docs)
    placed = _near(held.select("id", "m"), mapped, ["m"], F.col("id"), n).withColumn("t", F.coalesce("t", "m"))
    gone = _later(placed, placed.select("id", "t").distinct(), "t", min_docs)
    if passage is not None:
        long = held.filter(F.col("size") > passage).select("id", "m")
        gone = gone.unionByName(_later(long, long, "m", 2))
    gone = gone.groupBy(F.col("id").alias("__id")).agg(F.collect_set("m").alias("__gone"))
    return _rewritten(df, doc_id, text, gone, _tokens, _full)


def drop_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 50) -> DataFrame:
    """Rewrites ``text`` without lines of more than ``n_words`` words that a document with a smaller id holds too.

    Lines are equal if their words are. Adds ``n_lines`` (of more than ``n_words``) and ``n_dropped``.
    """
    ship(df.sparkSession)

    def long(line: Column) -> Column:
        w = words(line)
        return F.when(F.size(w) > n_words, w).otherwise(F.array().cast("array<string>"))

    split = F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    x = df.select(F.col(doc_id).cast("long").alias("id"), F.explode(split).alias("x")).select("id", long(F.col("x")).alias("k"))
    held = cut(x.filter(F.size("k") > 0).select("id", _hash(F.col("k")).alias("m")).distinct())
    gone = _later(held, held, "m", 2)
    gone = gone.groupBy(F.col("id").alias("__id")).agg(F.collect_set("m").alias("__gone"))
    return _rewritten(df, doc_id, text, gone, long, lambda x: F.size(long(x)) > 0)


def _rewritten(df: DataFrame, doc_id: str, text: str, gone: DataFrame, parse: Callable[[Column], Column], counts: Callable[[Column], Column]) -> DataFrame:
    """Texts without the lines whose hashes of parsed tokens ``gone`` (__id, __gone) holds; lines that don't count stay.

    Only texts with something to lose are parsed.
    """
    df = without(df, ["n_lines", "n_dropped", "__id", "__gone", "__l", "__m", "__left"])
    met = df.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")
    met = met.withColumn("__l", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    met = met.withColumn("__m", F.when(F.col("__gone").isNotNull(), F.transform("__l", lambda x: _hash(parse(x)))))
    met = met.withColumn("__left", _outside(F.col("__m"), F.col("__gone")))
    full = lambda c: F.size(F.filter(c, counts)).cast("long")
    lost = F.filter("__l", lambda x, i: counts(x) & ~F.get(F.col("__left"), i))
    out = met.withColumns({"n_lines": full("__l"), "n_dropped": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long")})
    kept = F.filter("__l", lambda x, i: ~counts(x) | F.get(F.col("__left"), i))
    fresh = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text, fresh).drop("__gone", "__l", "__m", "__left")
