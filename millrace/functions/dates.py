"""The run date of a job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession


def resolve_run_date(spark: SparkSession, value: str | dt.date) -> dt.date:
    """Turn ``"today"``, an ISO date or a date into one fixed date.

    ``"today"`` is the current date in the session time zone. It is resolved
    once, on the driver, so that every task and every retry of a job that
    crosses midnight filters on the same date.
    """
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if value.strip().lower() == "today":
        return spark.sql("SELECT current_date() AS today").first()["today"]
    return dt.date.fromisoformat(value.strip())


def resolve_run_dates(spark: SparkSession, value: Any) -> list[dt.date]:
    """The days that a job is run for: one date in any form, a list of them, or a mapping with ``from`` and ``to``.

    ``to`` counts as a day of its own and is today unless given.
    """
    if isinstance(value, Mapping):
        first, last = resolve_run_date(spark, value["from"]), resolve_run_date(spark, value.get("to") or "today")
        if last < first:
            raise ValueError(f"a run from {first} to {last} has no day")
        return [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    if isinstance(value, (str, dt.date)):
        return [resolve_run_date(spark, value)]
    return [resolve_run_date(spark, each) for each in value]
