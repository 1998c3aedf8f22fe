"""Reports of measured runs: estimates that a benchmark tool leaves in a folder tree, as a table, as text and as JSON."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESTIMATES = "mean struct<point_estimate double>, std_dev struct<point_estimate double>"


def estimates(spark: SparkSession, root: str) -> DataFrame:
    """(group, name, mean_ns, std_dev_ns) of all ``<root>/<group>/<name>/new/estimates.json``, by group and name.

    Files that are no such JSON, groups that begin with a dot and the group ``report`` are left out; no file gives no row.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/new/estimates.json")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return spark.createDataFrame([], "group string, name string, mean_ns double, std_dev_ns double")
    read = spark.read.schema(_ESTIMATES).option("multiLine", True).json(f"{root}/*/*/new/estimates.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = lambda k: F.url_decode(F.element_at(parts, k))
    rows = read.select(named(-4).alias("group"), named(-3).alias("name"), F.col("mean.point_estimate").alias("mean_ns"), F.col("std_dev.point_estimate").alias("std_dev_ns"))
    return rows.filter("mean_ns IS NOT NULL AND std_dev_ns IS NOT NULL AND NOT startswith(group, '.') AND group <> 'report'").orderBy("group", "name")


def stamp(seconds: float | None = None) -> str:
    """The time that a report bears."""
    return f"unix:{int(time.time() if seconds is None else seconds)}"


def as_json(rows: DataFrame, at: str | None = None) -> str:
    return json.dumps({"timestamp": at or stamp(), "results": [r.asDict() for r in rows.collect()]}, indent=2)


def as_text(rows: DataFrame) -> str:
    """A line a result under a line a group, and how many there are."""
    lines, group, n = [], None, 0
    for r in rows.toLocalIterator():
        if r["group"] != group:
            group = r["group"]
            lines += [f"[{group}]"]
        scale, unit = next(((s, u) for s, u in ((1e9, "s"), (1e6, "ms"), (1e3, "us")) if r["mean_ns"] >= s), (1.0, "ns"))
        lines.append(f"  {r['name']}: {r['mean_ns'] / scale:.2f} {unit} (+/- {r['std_dev_ns'] / scale:.2f})")
        n += 1
    return "\n".join([*lines, f"{n} results"])
