"""Folders for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path that every executor can reach.

    On a cluster this is a folder under ``spark.checkpoint.dir``, the shared
    folder the cluster names. A machine-local folder is used only when that is
    unset and Spark runs in this one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
