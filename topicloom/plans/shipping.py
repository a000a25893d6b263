"""Sending the package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application once; the driver's archive goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="topicloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))
    _shipped.add(app)
