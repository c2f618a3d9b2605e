"""Gives a cluster's Python workers this package where it isn't installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files once; executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId not in _DONE:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="spark-ship-")
        kept = Path(folder, "kept", root.name)
        shutil.copytree(root, kept, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", kept.parent))
        _DONE.add(context.applicationId)
    return spark
