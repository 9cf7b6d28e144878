"""One table from generations of files whose schemas differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField,
    StructType, TimestampNTZType,
)

from millrace.functions.schema import to_struct
from millrace.operators.columns import quoted
from millrace.sources.files import read_dataset
from millrace.sources.spec import DatasetSpec

_WHOLE = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def read_generations(
    spark: SparkSession, generations: Sequence[Mapping[str, Any] | DatasetSpec], schema: Any
) -> DataFrame:
    """The rows of all generations under one declared schema.

    A generation is a dataset of its own: a folder or several, in any format. Columns go by
    name, in any order. One that a generation lacks is null there; one that the schema does
    not have is left out; one of a narrower type is widened: whole numbers to longer ones, to
    doubles that hold them or to decimals, float to double, decimals to more digits on either
    side, date to timestamp without time zone. Anything else would lose values and raises before any row is read, as does
    a required column that a generation lacks.

    Parquet and ORC generations say their types themselves, in a footer; for CSV and JSON
    the generation declares its own schema. Filters and the choice of columns reach
    each generation's scan.
    """
    target = to_struct(schema)
    if target is None or not generations:
        raise ValueError("generations need a declared schema, and at least one of them")
    return reduce(DataFrame.unionAll, [_conformed(spark, DatasetSpec.of(each), target) for each in generations])


def _conformed(spark: SparkSession, generation: DatasetSpec, target: StructType) -> DataFrame:
    if generation.format.lower() in ("csv", "json") and generation.schema is None:
        raise ValueError(f"a {generation.format} generation declares its schema: {generation.path}")
    rows = read_dataset(spark, generation)
    own = {field.name: field for field in rows.schema}
    columns = []
    for field in target:
        if field.name in own:
            columns.append(_widened(own[field.name], field, generation))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"required column {field.name!r} is missing in {generation.path}")
    return rows.select(*columns)


def _widened(own: StructField, field: StructField, generation: DatasetSpec):
    if not widens(own.dataType, field.dataType):
        raise ValueError(
            f"column {field.name!r} of {generation.path} is {own.dataType.simpleString()}, "
            f"which {field.dataType.simpleString()} does not hold"
        )
    return F.col(quoted(own.name)).cast(field.dataType).alias(field.name)


def widens(narrow: DataType, wide: DataType) -> bool:
    """Does every value of the one type have an equal one of the other?"""
    if narrow == wide:
        return True
    digits = _WHOLE.get(type(narrow))
    if digits is not None:
        if type(wide) in _WHOLE:
            return digits < _WHOLE[type(wide)]
        if isinstance(wide, DoubleType):
            return digits <= 10
        if isinstance(wide, FloatType):
            return digits <= 5
        return isinstance(wide, DecimalType) and wide.precision - wide.scale >= digits
    if isinstance(narrow, DecimalType) and isinstance(wide, DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    if isinstance(narrow, FloatType):
        return isinstance(wide, DoubleType)
    return isinstance(narrow, DateType) and isinstance(wide, TimestampNTZType)
