"""Brings the package to Python workers that cannot import it from where they run."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package, zipped, to an application's files; once, and not if PYTHONPATH already leads workers to it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _done or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _done.add(sc.applicationId)
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/topolake", "zip", root, "topolake"))
