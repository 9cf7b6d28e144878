"""Rows written in the program itself."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.schema import to_struct


def rows_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], columns: Any) -> DataFrame:
    """Make a table of in-code rows.

    ``columns`` is a list of names, with the types taken from the values, or a
    declared schema in any form ``to_struct`` accepts.
    """
    names = not isinstance(columns, str) and all(isinstance(column, str) for column in columns)
    if names and isinstance(columns, Sequence):
        return spark.createDataFrame(rows, list(columns))
    return spark.createDataFrame(rows, to_struct(columns))
