"""Hands the package to the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import faultline


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_faultline_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(faultline.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="faultline-"), "faultline"), "zip", root, "faultline"))
        sc._faultline_shipped = True
