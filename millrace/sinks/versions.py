"""Datasets whose overwrites readers never see half done.

Each overwrite goes to a folder of its own, ``_versions/<id>``. When it is whole it is
published by an empty file ``_published/<number>-<id>``; readers follow the one with the
greatest number. A write that dies leaves no such file, and so the rows before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from millrace.sources.storage import child_names, create_empty, delete_folder

_MARKS, _DATA, _CLAIMS = "_published", "_versions", "_claimed"


def new_version(path: str) -> tuple[str, str]:
    """An id for a version that is about to be written, and its folder."""
    version = uuid.uuid4().hex
    return version, version_path(path, version)


def version_path(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/{_DATA}/{version}"


def published(spark: SparkSession, path: str) -> list[str]:
    """The ids of the published versions that are still there, the oldest first."""
    return [name.split("-", 1)[1] for name in child_names(spark, f"{path.rstrip('/')}/{_MARKS}")]


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the version that is read."""
    versions = published(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} has no published version")
    return version_path(path, versions[-1])


def publish(spark: SparkSession, path: str, version: str, after: list[str]) -> None:
    """Make a whole version the current one.

    ``after`` are the versions that were there when the write began. If another was
    published meanwhile, this one is refused: its rows may come from older ones. Two that
    end at once claim one number; on a file system that creates a file only once, as HDFS
    does, the second fails. A writer that dies between its claim and the mark leaves a claim
    that refuses the next ones: ``release_claim`` drops it.
    """
    marks = f"{path.rstrip('/')}/{_MARKS}"
    names = child_names(spark, marks)
    if [name.split("-", 1)[1] for name in names][-1:] != after[-1:]:
        raise RuntimeError(f"another version of {path} was published during the write")
    number = int(names[-1].split("-", 1)[0]) + 1 if names else 1
    if not create_empty(spark, f"{path.rstrip('/')}/{_CLAIMS}/{number:012d}"):
        raise RuntimeError(f"another version of {path} was published during the write")
    create_empty(spark, f"{marks}/{number:012d}-{version}")


def release_claim(spark: SparkSession, path: str) -> None:
    """Drop a claim whose writer died before it published; call it while no other write runs."""
    names = child_names(spark, f"{path.rstrip('/')}/{_MARKS}")
    number = int(names[-1].split("-", 1)[0]) + 1 if names else 1
    delete_folder(spark, f"{path.rstrip('/')}/{_CLAIMS}/{number:012d}")


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all published versions but the last ``keep``, and say which.

    A query that reads an old version fails when it goes, so keep as many as queries
    may be behind. Versions that were never published belong to writes that run or died;
    they are left alone.
    """
    if keep < 1:
        raise ValueError("the current version has to stay")
    gone = published(spark, path)[:-keep]
    marks = f"{path.rstrip('/')}/{_MARKS}"
    for name in child_names(spark, marks):
        if name.split("-", 1)[-1] in gone:
            # The mark goes first: no reader may follow it to a folder that is going.
            delete_folder(spark, f"{marks}/{name}")
    for version in gone:
        delete_folder(spark, version_path(path, version))
    return gone
