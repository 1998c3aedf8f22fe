"""Where tables go that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only if
    driver and executors are one process, as in tests; on a cluster that raises ValueError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a table, now or when the driver ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(there) if at_exit else fs.delete(there, True)
