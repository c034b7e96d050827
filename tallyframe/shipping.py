"""Making this package importable on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: str | None = None


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the executors, once for each application."""
    global _shipped
    spark = spark or SparkSession.getActiveSession()
    if spark is None or _shipped == spark.sparkContext.applicationId:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallyframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{top.name}.zip", "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(f"{folder}/{top.name}.zip")
    _shipped = spark.sparkContext.applicationId
