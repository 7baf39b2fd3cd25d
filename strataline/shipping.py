"""Make this package importable in Python workers, however the driver found it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors as a zip, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ship-"), name), "zip", top, name)
        context.addPyFile(made)
        _shipped.add(context.applicationId)
    return spark
