"""Appends that may be repeated.

A run writes under its id, ``run_id=<id>`` as the first partition. Its rows are written
beside it and put in its place when they are whole, so a run that is repeated replaces
its own rows, the days it no longer has included, and no other run's.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from millrace.sources.storage import replace_folder

RUN_COLUMN = "run_id"
# What stands for itself in a partition folder's name on any file system.
_PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")


def staging_path(path: str) -> str:
    """A new folder for the rows of a run; readers do not look into it."""
    return f"{path.rstrip('/')}/_staged/{uuid.uuid4().hex}"


def run_path(path: str, run_id: str) -> str:
    if not _PLAIN.match(run_id):
        raise ValueError(f"a run id has letters, digits, '.', '_' and '-' only: {run_id!r}")
    return f"{path.rstrip('/')}/{RUN_COLUMN}={run_id}"


def finish_run(spark: SparkSession, staged: str, path: str, run_id: str) -> None:
    """Put whole rows in the place of the run's earlier ones."""
    replace_folder(spark, staged, run_path(path, run_id))
