"""Counting, sorting and looking at rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from millrace.operators.columns import quoted


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows; parquet and orc read no column for it."""
    return df.agg(F.count(F.lit(1)).alias(name))


def sort_rows(df: DataFrame, *by: str | Column, unique: bool = False, copies: bool = False) -> DataFrame:
    """Sort the whole table.

    Spark sorts by ranges of the key, and equal keys share a range, so one hot
    key would be one task. Ties are therefore broken by a hash of the row: the
    ranges can then cut through a hot key, filters put on the result still reach
    the scan, and a repeated task sends its rows to the same places. Columns that
    Spark cannot hash, such as maps, stay out of it. Say ``unique=True`` where the
    key has no ties, to sort by the key alone.

    Copies of a whole row have one hash. ``copies=True`` breaks their ties by the
    input partition as well, down to what one input task held; put filters before
    such a sort, since none put after it can pass that number.
    """
    if unique:
        return df.orderBy(*by)
    hashable = [F.col(quoted(field.name)) for field in df.schema if _hashable(field.dataType)]
    ties = [F.xxhash64(*hashable)] if hashable else []
    return df.orderBy(*by, *ties, *([F.spark_partition_id()] if copies or not hashable else []))


def _hashable(kind: DataType) -> bool:
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


def preview(df: DataFrame, n: int = 5, by: str | Column | None = None) -> DataFrame:
    """The first ``n`` rows: in the order of ``by``, or any that come cheaply.

    With an order each task keeps its own first ``n`` and only those meet.
    """
    return (df if by is None else df.orderBy(by)).limit(n)


def show_sample(df: DataFrame, n: int = 5) -> None:
    """Print the schema and ``n`` rows."""
    df.printSchema()
    df.show(n)
