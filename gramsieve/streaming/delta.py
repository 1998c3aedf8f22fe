"""Freshness: changed files over a base corpus, as snapshots and as a stream of changes.

A change is (path, op, content, seq): op A or M holds the new content, D none; the last of a path by seq wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramsieve.operators.search import find_matches

CHANGE = "path string, op string, text string, seq long"


def latest(changes: DataFrame) -> DataFrame:
    """One row a path: its last change."""
    return changes.groupBy("path").agg(F.max_by(F.struct("op", "text", "seq"), "seq").alias("c")).select("path", "c.*")


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, text) after the changes: base files that no change names, and the live changed ones."""
    last = latest(changes)
    kept = base.select("path", "text").join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.filter("op <> 'D'").select("path", "text"))


def search(base: DataFrame, changes: DataFrame, pattern: str) -> DataFrame:
    """Matches of the merged corpus; a changed file is searched in its new form only."""
    return find_matches(merged(base, changes), pattern)


def search_indexed(index, base: DataFrame, changes: DataFrame, pattern: str) -> DataFrame:
    """The same, reading base files by their index (file_id, path, text) and changed ones by scan."""
    last = latest(changes)
    old = index.search(base.join(last.select("path"), "path", "left_anti"), pattern)
    return old.unionByName(find_matches(last.filter("op <> 'D'"), pattern))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of files Added, Modified or Deleted between two snapshots (path, text); contents meet as hashes."""
    h = F.sha1(F.coalesce("text", F.lit("")).cast("binary"))
    a, b = before.select("path", h.alias("old")), after.select("path", h.alias("new"))
    status = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("old") != F.col("new"), "Modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")


def update_plan(changed: int, total: int, percent: int = 50) -> dict:
    """Whether an update has anything to do, and whether so much changed that a rebuild is called for."""
    ratio = 100 * changed / total if total else 100.0
    return {"up_to_date": changed == 0, "changed_files": changed, "rebuild": changed > 0 and ratio > percent}


def compact(index_postings: DataFrame, changed_ids: DataFrame, fresh_postings: DataFrame) -> DataFrame:
    """Postings with those of changed or deleted files replaced; other grams' rows pass unread."""
    return index_postings.join(changed_ids.select("file_id"), "file_id", "left_anti").select("gram", "file_id").unionByName(fresh_postings.select("gram", "file_id"))


def follow(changes: DataFrame, base: DataFrame, pattern: str, sink, checkpoint: str):
    """Runs a stream of changes: each batch's last change of a path is searched and given to ``sink(matches, batch_id)``.

    ``base`` is not read again; deletes give no matches and tell the sink's owner by their absence.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        sink(find_matches(latest(rows).filter("op <> 'D'"), pattern), batch_id)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
