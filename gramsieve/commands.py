"""The engine's commands as functions, and ``python -m gramsieve.commands`` as their command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.operators import budgets, reports
from gramsieve.operators import index as ix
from gramsieve.operators import search as scans
from gramsieve.plans import planner
from gramsieve.sources import corpus as sources
from gramsieve.streaming import overlay


def place(root: str, target: str | None = None) -> str:
    """Where the index of a tree lies, unless it is told."""
    return target or f"{root.rstrip('/')}/{overlay.INTERNAL}"


def _files(spark: SparkSession, root: str, **walk) -> DataFrame:
    return sources.read_tree(spark, root, **walk).filter(~overlay.is_internal(F.col("path")))


def index(spark: SparkSession, root: str, target: str | None = None, full: bool = False, percent: int = 50, **walk) -> dict:
    """Builds the index of a tree, or brings it up to date; says what it did."""
    if not full:
        return overlay.update(spark, root, place(root, target), percent, **walk)
    ix.build(ix.number_files(_files(spark, root, **walk).select("path", "text")), place(root, target), base=overlay._commit(root))
    return {"up_to_date": False, "changed_files": 0, "rebuild": True, "forced": False}


def search(spark: SparkSession, root: str, pattern: str, target: str | None = None, scan: bool = False, override: planner.Override = planner.Override.AUTO, fresh: bool = True, **walk) -> DataFrame:
    """The matches in a tree, in order: by its index if there is one, else, or with ``scan``, by reading all files.

    With ``fresh``, files that differ from what the index saw are searched as they are now; the walk's options hold either way.
    """
    files = _files(spark, root, **walk).select("path", "text")
    if not scan:
        try:
            known = ix.Index.open(spark, place(root, target), check=False)
        except Exception:  # no index, or none that can be read: the scan gives the same answer
            known = None
        if known is not None:
            seen = files.join(known.files.select("path", "file_id", "hash"), "path", "left")
            same = seen.filter(F.xxhash64("text") == F.col("hash"))
            found = known.search(same if fresh else seen.filter("file_id IS NOT NULL"), pattern, override)
            if fresh:
                found = found.unionByName(scans.find_matches(seen.filter(~F.coalesce(F.xxhash64("text") == F.col("hash"), F.lit(False))), pattern))
            return scans.ordered(found)
    return scans.ordered(scans.find_matches(files, pattern))


def search_files(spark: SparkSession, root: str, pattern: str, **options) -> DataFrame:
    """The paths with a match, in order."""
    return search(spark, root, pattern, **options).select("path").distinct().orderBy("path")


def plan(spark: SparkSession, pattern: str, override: planner.Override = planner.Override.AUTO) -> DataFrame:
    return planner.diagnostics(spark, [pattern], override)


def stats(spark: SparkSession, root: str, target: str | None = None) -> DataFrame:
    """One row: counts of the index and the distribution of its lists' sizes."""
    known = ix.Index.open(spark, place(root, target))
    return known.counts().drop("ngram_count").join(known.stats())


def check_budgets(spark: SparkSession, comparison: str, budget: str, mapping: list[tuple[str, str]]) -> DataFrame:
    """Comparison text against budgets (TOML text); ``mapping`` has (glob, budget), the first that fits counts."""
    lines = spark.createDataFrame(list(enumerate(comparison.split("\n"))), "n int, line string")
    globs = spark.createDataFrame([(g, k, i) for i, (g, k) in enumerate(mapping)], "glob string, key string, place int")
    return budgets.check(budgets.parse_changes(lines), budgets.load_budgets(spark, budget), globs)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gramsieve")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "plan", "stats", "report", "check-budgets"):
        sub = commands.add_parser(name)
        if name in ("search", "plan"):
            sub.add_argument("pattern")
            sub.add_argument("--strategy", choices=[o.value for o in planner.Override], default="auto")
        if name in ("index", "search", "stats"):
            sub.add_argument("--root", default=".")
            sub.add_argument("--index")
        if name in ("index", "search"):
            sub.add_argument("--largest", type=int, default=sources.LARGEST)
            sub.add_argument("--hidden", action="store_true")
            sub.add_argument("--binary", action="store_true")
        if name == "index":
            sub.add_argument("--full", action="store_true")
        if name == "search":
            sub.add_argument("--files", action="store_true")
            sub.add_argument("--scan", action="store_true")
        if name == "report":
            sub.add_argument("folder")
            sub.add_argument("--json", action="store_true")
        if name == "check-budgets":
            sub.add_argument("comparison")
            sub.add_argument("budgets")
            sub.add_argument("--map", action="append", default=[], help="GLOB=BUDGET")
    told = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    walk = {k: getattr(told, k) for k in ("largest", "hidden", "binary") if hasattr(told, k)}
    match told.command:
        case "index":
            print(index(spark, told.root, told.index, told.full, **walk))
        case "search":
            options = {"target": told.index, "scan": told.scan, "override": planner.Override(told.strategy)} | walk
            found = search_files(spark, told.root, told.pattern, **options) if told.files else scans.format_matches(search(spark, told.root, told.pattern, **options))
            for row in found.toLocalIterator():
                print(row[0])
        case "plan":
            print(plan(spark, told.pattern, planner.Override(told.strategy)).head().asDict())
        case "stats":
            print(stats(spark, told.root, told.index).head().asDict())
        case "report":
            rows = reports.estimates(spark, told.folder)
            print(reports.as_json(rows) if told.json else reports.as_text(rows))
        case "check-budgets":
            with open(told.comparison) as a, open(told.budgets) as b:
                checked = check_budgets(spark, a.read(), b.read(), [tuple(m.split("=", 1)) for m in told.map]).collect()
            for row in checked:
                print(row.asDict())
            return int(any(r.status in ("warning", "critical") for r in checked))
    return 0


if __name__ == "__main__":
    sys.exit(main())
