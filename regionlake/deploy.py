"""Making the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (the same as ``--py-files``)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
    archive = shutil.make_archive(str(base), "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
