"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import millrace

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, through Spark's own file distribution.

    The functions that run in Python workers import it there, and a worker sees
    neither the driver's ``sys.path`` nor its working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(millrace.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="run-"), "millrace.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("millrace", os.path.relpath(path, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
