"""Performance budgets: measured changes against allowed ones."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allowed change in percent where a budget states none (fixed value).
DEFAULT_PCT = 20.0
BUDGET = "key string, regression_pct double, p50_regression_pct double, throughput_regression_pct double, critical boolean, description string"


def human_bytes(n: Column) -> Column:
    """A size with one decimal, by powers of 1024."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def glob_regex(glob: Column) -> Column:
    """A glob of /-segments, where * stands for any run within a segment, as a regular expression."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(glob, r"([.+()\[\]{}|^$?\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit("$"))


def load_budgets(spark: SparkSession, text: str) -> DataFrame:
    """Budgets of a TOML text: every table with a key ``critical`` is one, named by its dotted path."""
    names = [c.split()[0] for c in BUDGET.split(", ")]
    rows = []

    def walk(table: dict, path: list[str]) -> None:
        if "critical" in table:
            pct = {k: None if table.get(k) is None else float(table[k]) for k in names[1:4]}
            rows.append((".".join(path), *pct.values(), bool(table["critical"]), table.get("description")))
            return
        for k, v in table.items():
            if isinstance(v, dict):
                walk(v, [*path, k])

    walk(tomllib.loads(text), [])
    return spark.createDataFrame(rows, BUDGET)


def parse_changes(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """(bench, change_pct) of comparison text: a name, on its own line or before it, then ``change: [low middle high]``.

    A name carries to the first change after it, so lines are taken in order; a report is small.
    """
    text = F.trim(line)
    change = F.regexp_extract(text, r"change:\s*\[\S+\s+([+-]?[0-9.]+)%?\s+\S+\]", 1)
    before = F.trim(F.regexp_extract(text, r"^(\S+)\s+.*change:", 1))
    own = F.when(before != "", before).when(~text.contains(":") & ~text.contains("[") & (text != ""), text)
    from pyspark.sql import Window as W

    x = lines.select(order, own.alias("own"), F.when(change != "", change.cast("double")).alias("change_pct"))
    x = x.withColumn("bench", F.last("own", ignorenulls=True).over(W.orderBy(order)))
    return x.filter("change_pct IS NOT NULL").select("bench", "change_pct")


def check(changes: DataFrame, budgets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per bench: its budget by the first mapping (glob, key, place) that fits, the allowed change and a status."""
    m = mapping.select("key", "place", glob_regex(F.col("glob")).alias("re"))
    met = changes.join(m, F.expr("bench RLIKE re"), "left").groupBy("bench", "change_pct").agg(F.min_by("key", "place").alias("key"))
    allowed = F.coalesce("regression_pct", "p50_regression_pct", "throughput_regression_pct", F.lit(DEFAULT_PCT))
    b = budgets.select("key", allowed.alias("allowed_pct"), "critical")
    status = F.when(F.col("allowed_pct").isNull(), "unmapped").when(F.col("change_pct") > F.col("allowed_pct"), F.when(F.col("critical"), "critical").otherwise("warning")).otherwise("pass")
    return met.join(b, "key", "left").select("bench", "change_pct", "key", "allowed_pct", status.alias("status"))


def tally(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count("*").alias("n"))
