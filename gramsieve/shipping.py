"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of all tasks, once an application; Spark's file server carries it."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(root.name) / p.relative_to(root))), p.read_bytes())
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
