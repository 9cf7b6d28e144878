"""Files and folders, through the file system that Spark reads them from."""

from __future__ import annotations

from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path on it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of that name?"""
    system, place = _at(spark, path)
    return bool(system.exists(place))


def has_files(spark: SparkSession, path: str) -> bool:
    """Does the folder hold any data file, at any depth? Stops at the first; names with ``_`` or ``.`` in front do not count."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return False
    if system.getFileStatus(place).isFile():
        return True
    folders = [place]
    while folders:
        entries = system.listStatusIterator(folders.pop())
        while entries.hasNext():
            entry = entries.next()
            if entry.getPath().getName().startswith(("_", ".")):
                continue
            if entry.isFile():
                return True
            folders.append(entry.getPath())
    return False


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder. For folders of few entries."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def create_empty(spark: SparkSession, path: str) -> bool:
    """Create an empty file, unless there is one of that name; ``False`` then."""
    system, place = _at(spark, path)
    return bool(system.createNewFile(place))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    system, place = _at(spark, path)
    if system.exists(place) and not system.delete(place, True):
        raise PySparkException(f"could not delete {path}")


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``, whose content is dropped."""
    system, place = _at(spark, path)
    system.mkdirs(place.getParent())
    delete_folder(spark, path)
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(new), place):
        raise PySparkException(f"could not rename {new} to {path}")
