"""Changes over an index: the files that changed since it was built, indexed in a layer of their own.

A layer's files have ids from ``FIRST`` on, so that both layers' ids differ; its deletes and changes hide the base's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.operators import index as ix
from gramsieve.operators.search import find_matches
from gramsieve.plans.planner import Override
from gramsieve.sources import corpus as sources
from gramsieve.streaming import delta

#: The first id of a layer over a base (fixed value).
FIRST = 1_000_000_000
#: Folders that hold indexes; what changes there is no change.
INTERNAL = ".gramsieve"
STATUS = "path string, status string"


def is_internal(path, folder: str = INTERNAL):
    """Whether a path lies in an index's own folder; of a string or of a column."""
    return path.rlike(f"(^|/){folder.replace('.', '[.]')}(/|$)") if hasattr(path, "rlike") else folder in path.split("/")


def changes_of(dirty: DataFrame, corpus: DataFrame, seq: int = 0) -> DataFrame:
    """Changes (path, op, text, seq) of listed files (path, status): Added and Modified ones with their text now, Deleted ones
    without; listed files that can't be read any more are left out, and so is what lies in an index's folder."""
    some = dirty.filter(~is_internal(F.col("path"))).distinct()
    live = some.filter("status <> 'Deleted'").join(corpus.select("path", "text"), "path")
    op = F.when(F.col("status") == "Added", "A").otherwise("M")
    gone = some.filter("status = 'Deleted'").select("path", F.lit("D").alias("op"), F.lit(None).cast("string").alias("text"))
    return live.select("path", op.alias("op"), "text").unionByName(gone).withColumn("seq", F.lit(seq).cast("long"))


class Overlay:
    """The last change of each path, with the live ones numbered and indexed."""

    def __init__(self, changes: DataFrame, first: int = FIRST, sparse: bool = True):
        self.last = delta.latest(changes)
        live = self.last.filter("op <> 'D'").select("path", "text")
        self.corpus = ix.number_files(live).withColumn("file_id", F.col("file_id") + first)
        self.index = ix.Index(self.corpus.select("file_id", "path", F.octet_length("text").cast("long").alias("n_bytes")), ix.postings_of(self.corpus, sparse=sparse), sparse=sparse, of_grams=lambda some: ix.postings_of(self.corpus, sparse=sparse, only=some))

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> Overlay:
        return cls(spark.createDataFrame([], delta.CHANGE), **options)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, dirty: list[tuple[str, str]], **options) -> Overlay:
        """From listed files of a tree; their texts are read now."""
        listed = spark.createDataFrame(dirty, STATUS)
        return cls(changes_of(listed, sources.read_tree(spark, root).join(listed.select("path"), "path", "left_semi")), **options)

    @classmethod
    def of_repository(cls, spark: SparkSession, root: str, base: str | None = None, **options) -> Overlay:
        """From what differs from the last commit, or from the commit ``base``."""
        repository = sources.Repository(root)
        return cls.of_tree(spark, repository.root, repository.dirty() if base is None else repository.changes_since(base), **options)

    def put(self, path: str, text: str) -> Overlay:
        """The layer with one more file, or with a file's new text."""
        return self._with(path, "M", text)

    def delete(self, path: str) -> Overlay:
        """The layer with a file deleted; its grams go."""
        return self._with(path, "D", None)

    def _with(self, path: str, op: str, text: str | None) -> Overlay:
        spark = self.last.sparkSession
        after = self.last.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).head()[0]
        return Overlay(self.last.select("path", "op", "text", "seq").unionByName(spark.createDataFrame([(path, op, text, after)], delta.CHANGE)), sparse=self.index.sparse)

    def lookup(self, grams: list[bytes]) -> DataFrame:
        return self.index.lookup(grams)

    def all_of(self, grams: list[bytes]) -> DataFrame:
        """Live files of the layer that hold all grams; without grams all of them."""
        return self.index.all_of(grams)

    def path_of(self, ids: DataFrame) -> DataFrame:
        return self.index.path_of(ids)

    def candidates(self, pattern: str, override: Override = Override.AUTO) -> DataFrame:
        return self.index.candidates(self.index.plan(pattern, override))

    def deleted(self) -> DataFrame:
        return self.last.filter("op = 'D'").select("path")

    def is_deleted(self, path: str) -> bool:
        return not self.deleted().filter(F.col("path") == path).isEmpty()

    def counts(self) -> DataFrame:
        """One row: live files, deleted ones, and whether there is no change at all."""
        return self.last.agg(F.count_if(F.col("op") != "D").alias("file_count"), F.count_if(F.col("op") == "D").alias("deleted_count"), (F.count("*") == 0).alias("is_empty"))

    def search(self, base: ix.Index, corpus: DataFrame, pattern: str, override: Override = Override.AUTO) -> DataFrame:
        """Matches of base (file_id, path, text) and layer as one corpus, by the index of each; a path that the layer names is
        read there alone."""
        old = base.search(corpus.join(self.last.select("path"), "path", "left_anti"), pattern, override)
        return old.unionByName(self.index.search(self.corpus, pattern, override))


def scan(base: DataFrame, overlay: Overlay, pattern: str) -> DataFrame:
    """The same by reading all texts."""
    return find_matches(delta.merged(base, overlay.last), pattern)


def update(spark: SparkSession, root: str, target: str, percent: int = 50, **walk) -> dict:
    """Brings the index at ``target`` up to the tree ``root``; says what it did.

    Snapshots are compared by content, so no version control is needed. Without changes nothing is written; otherwise the index
    of unchanged files is kept row by row and only changed files are indexed, unless more than ``percent`` of all files
    changed, or there is no index, which calls for a new one. The new tables stand beside the old until they are complete.
    """
    now = sources.read_tree(spark, root, **walk).filter(~is_internal(F.col("path")))
    try:
        old = ix.Index.open(spark, target)
    except Exception:  # none there, or one that can't be read: any reason calls for a new one
        ix.build(ix.number_files(now.select("path", "text")), target, base=_commit(root))
        return {"up_to_date": False, "changed_files": 0, "rebuild": True, "forced": True}
    files = now.select("path", F.xxhash64("text").alias("now"))
    changed = old.files.select("path", "file_id", "hash").join(files, "path", "full_outer").filter(~F.col("hash").eqNullSafe(F.col("now")))
    listed = changed.select("path", "file_id", F.col("now").isNotNull().alias("live"))
    found = listed.agg(F.count("*").alias("n")).head()["n"]
    done = delta.update_plan(found, old.files.count(), percent) | {"forced": False}
    if done["up_to_date"]:
        return done
    if done["rebuild"]:
        ix.build(ix.number_files(now.select("path", "text")), f"{target}.new", base=_commit(root))
    else:
        first = old.files.agg(F.coalesce(F.max("file_id"), F.lit(-1)) + 1).head()[0]
        fresh = ix.number_files(now.select("path", "text").join(listed.filter("live").select("path"), "path", "left_semi")).withColumn("file_id", F.col("file_id") + first)
        gone = listed.filter("file_id IS NOT NULL").select("file_id")
        ix.write(
            old.files.join(gone, "file_id", "left_anti").unionByName(ix.files_of(fresh)),
            delta.compact(old.postings, gone, ix.postings_of(fresh, sparse=old.sparse)),
            f"{target}.new", old.sparse, _commit(root),
        )
    ix.replace(spark, f"{target}.new", target)
    return done


def _commit(root: str) -> str | None:
    try:
        return sources.Repository(root).head()
    except (ValueError, OSError):
        return None
