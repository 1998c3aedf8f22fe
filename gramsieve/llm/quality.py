"""Rule bitmask ledger for document quality, in DataFrame functions only.

``ledger`` evaluates every rule once a document and stores the measurements and a mask of the rules that failed.
``judge`` applies a versioned policy, a choice of rules, to that mask without reading the text again. ``ablate`` counts,
from the masks alone, what each rule of each policy rejects and what it alone rejects: equal masks are counted first, so
what is shuffled grows with the number of different masks and not with the documents.

All measurements of a document come from its own row, so nothing is shuffled before the ablation and no source, copy or
length can be hot. Windows of words are compared by 64-bit hashes within one text.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are judged alike, each on its
own; columns named as the ledger's are replaced, all others stay; empty tables give empty ledgers.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramsieve.llm.common import SPACES, without, words

#: Characters counted as symbols, as a fixed value.
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition on the measurements; ``bit`` is its place in the mask and never reused."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
)
#: Versions are never edited; a change makes a new one.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines"),
}


def mask(policy: str, rules: Iterable[Rule] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in POLICIES[policy])


def _twins(ordered: Column) -> Column:
    """Starts of the windows whose hash occurs twice or more, from (hash, start) pairs in order; ``ordered`` must be a stored column, as lambdas read it again and again."""

    def twin(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

    return F.transform(F.filter(ordered, twin), lambda x: x["i"])


def ledger(df: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """Adds the measurements, ``fail_bits`` (long, one bit a failed rule) and no verdict."""
    out = without(df, [*MEASURES, "fail_bits", "__w", "__h", "__s", "__l"])
    content = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn("__w", words(F.col(text)))
    out = out.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    # window hashes; slices of the hash array are read by position, so no window is ever built as text
    n = F.size("__h")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)]),
    )
    out = out.withColumn("__h", F.when(n > WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window; they are told by a hash set, which costs less than a sort
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    out = out.withColumn("__s", F.sort_array(_twins(F.col("__s"))))
    covered = F.aggregate(
        F.col("__s"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p.cast("long"))).alias("n"), (p.cast("long") + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(content, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.withColumn("__l", lines)
    measured = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(content, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # a generator stops later filters from being pushed below it, where each use would measure the text again
    out = out.select(*[c for c in out.columns if c not in ("__w", "__h", "__s", "__l")], F.inline(F.array(measured)))
    bits = sum((F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules), F.lit(0).cast("long"))
    return out.withColumn("fail_bits", bits)


def judge(book: DataFrame, policy: str = "v1", verdict: str = "kept") -> DataFrame:
    """Adds ``verdict``: true where no rule of the policy failed."""
    return without(book, [verdict]).withColumn(verdict, F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablate(book: DataFrame, policies: Iterable[str] = tuple(POLICIES), rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row a policy and rule: documents, those the policy rejects, those the rule fails, and those kept without it."""
    counted = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask(p, rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies
        for r in rules
        if r.name in POLICIES[p]
    ]
    x = counted.withColumn("c", F.explode(F.array(*cases))).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return x.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit != 0).alias("n_rejected"),
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only_this"),
        F.bit_or(hit).alias("bits_seen"),
    )
