"""Row filters, written so that they reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from millrace.operators.columns import quoted


def filter_threshold(column: str, threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Transform that keeps the rows with ``column >= threshold``."""

    def transform(df: DataFrame) -> DataFrame:
        return df.filter(F.col(quoted(column)) >= F.lit(threshold))

    return transform


def filter_processing_date(column: str, date: dt.date) -> Callable[[DataFrame], DataFrame]:
    """Transform that keeps the rows of one day.

    The bare column is compared, never a function of it: equality on a date
    column prunes partitions, and a half-open range on a timestamp is pushed to
    the scan. Text is cast to a date first: that still prunes partitions of a text
    partition column, but reaches no other scan, and under ANSI mode one malformed
    value fails the job.
    """

    def transform(df: DataFrame) -> DataFrame:
        value, kind = F.col(quoted(column)), df.select(quoted(column)).schema[0].dataType
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            start = F.lit(date).cast(kind)
            end = F.lit(date + dt.timedelta(days=1)).cast(kind)
            return df.filter((value >= start) & (value < end))
        if not isinstance(kind, DateType):
            value = F.to_date(value)
        return df.filter(value == F.lit(date))

    return transform


def filter_processing_dates(column: str, dates: Iterable[dt.date]) -> Callable[[DataFrame], DataFrame]:
    """Transform that keeps the rows of several days, for one plan instead of a job per day.

    As with one day, the bare column is compared: a date column with a list of days, which
    prunes partitions to that list, and a timestamp with a half-open range for each stretch
    of days that follow each other.
    """
    days = sorted(set(dates))

    def transform(df: DataFrame) -> DataFrame:
        value, kind = F.col(quoted(column)), df.select(quoted(column)).schema[0].dataType
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            stretches = [
                (value >= F.lit(first).cast(kind)) & (value < F.lit(last + dt.timedelta(days=1)).cast(kind))
                for first, last in _stretches(days)
            ]
            return df.filter(reduce(Column.__or__, stretches, F.lit(False)))
        if not isinstance(kind, DateType):
            value = F.to_date(value)
        return df.filter(value.isin(days))

    return transform


def _stretches(days: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    found: list[tuple[dt.date, dt.date]] = []
    for day in days:
        if found and day - found[-1][1] == dt.timedelta(days=1):
            found[-1] = (found[-1][0], day)
        else:
            found.append((day, day))
    return found
