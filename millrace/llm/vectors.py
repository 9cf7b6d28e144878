"""Checks shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: str) -> Column:
    """True for a vector that is there and has only finite components; an empty one counts as such."""
    return F.col(vector).isNotNull() & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )


def as_double(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``, the components as doubles."""
    return df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
