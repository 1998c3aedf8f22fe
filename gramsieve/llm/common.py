"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.places import remove, shared_dir

#: Words are maximal runs of characters outside this class (space and \t \n \v \f \r).
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none. Splits on one character, which needs no regular expression;
    one that finds the other spaces costs less than ``translate``, which makes an object of every character."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES[1:]}]", " ")
    return F.array_remove(F.split(plain, " "), "")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops columns whose names an operator is about to add (names compare without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


#: Paths of tables that open scratches hold.
_HELD: list[list[str]] = []


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """The same rows without their lineage, from a Parquet table in the shared folder, which outlives lost executors.

    One job writes it, where a checkpoint would run the last stage twice. The table goes with the scratch around the call,
    or, without one or with ``keep``, with the driver. Spark frees the shuffle files and broadcasts of what lies behind only
    when the driver collects its garbage; a driver program of many phases would hold them all, so garbage is collected here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    remove(spark, path, at_exit=True)
    if _HELD and not keep:
        _HELD[-1].append(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``cut`` writes inside, at the end; nothing lazy may leave the block but over kept tables."""
    _HELD.append([])
    try:
        yield
    finally:
        for path in _HELD.pop():
            remove(spark, path)


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 16, large: bool = False) -> DataFrame:
    """Left join with a small-per-key right side (one row a key), where one key may hold a third of the left rows.

    ``spread`` deals the left rows of a key over ``salts`` values; the right rows are repeated once a salt. Rows of the
    left side with a null key keep null right columns.
    """
    name = "__salt"
    dealt = left.withColumn(name, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge") if large else copies, [*keys, name], "left").drop(name)
