"""Data-quality checks that a declared schema implies."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from millrace.functions.schema import to_struct
from millrace.operators.columns import quoted


def required_field_violations(df: DataFrame, schema: Any) -> DataFrame:
    """One row with the number of nulls in each field declared ``nullable: false``.

    Spark does not enforce that declaration on file sources. All fields are
    counted in one pass that reads only them.
    """
    required = [f.name for f in to_struct(schema) or () if not f.nullable]
    if not required:
        raise ValueError("the schema declares no required field")
    return df.agg(*(F.count(F.when(F.col(quoted(name)).isNull(), F.lit(1))).alias(name) for name in required))
