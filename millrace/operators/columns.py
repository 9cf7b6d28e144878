"""Column transforms."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

log = logging.getLogger(__name__)


def upper_column(column: str = "name", target: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Transform that adds ``target`` (``<column>_upper``) with the text in upper case.

    A table without the column passes through unchanged, with a warning. The
    name has to match exactly, including its case.
    """
    target = target or f"{column}_upper"

    def transform(df: DataFrame) -> DataFrame:
        if column not in df.columns:
            log.warning("no column %r, rows pass through unchanged", column)
            return df
        return df.withColumn(target, F.upper(F.col(quoted(column))))

    return transform


def quoted(column: str) -> str:
    """The name as one identifier, also when it holds dots or backticks."""
    return "`" + column.replace("`", "``") + "`"
