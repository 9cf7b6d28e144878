"""Required fields and malformed records, checked in the pass that writes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators.columns import quoted

# Columns that a checked dataset has besides its own.
STATUS, REASON = "row_status", "rejected_for"
ACCEPTED, REJECTED = "accepted", "rejected"
# Columns of a scan that keeps malformed records.
RECORD, RECORD_FILE = "malformed_record", "malformed_file"


def required_fields(schema: StructType | None) -> list[str]:
    return [field.name for field in schema or () if not field.nullable]


def with_status(df: DataFrame, schema: StructType | None) -> DataFrame:
    """Add whether a row is accepted, and what it is rejected for: the required fields that are
    null, joined by commas, after ``malformed`` for a record that the scan could not read."""
    taken = {column.lower() for column in df.columns} & {STATUS, REASON}
    if taken:
        raise ValueError(f"a checked dataset has columns {STATUS} and {REASON} of its own: {sorted(taken)}")
    reasons = [F.when(F.col(quoted(name)).isNull(), F.lit(name)) for name in required_fields(schema)]
    if RECORD in df.columns:
        reasons.insert(0, F.when(F.col(RECORD).isNotNull(), F.lit("malformed")))
    reason = F.concat_ws(",", *reasons) if reasons else F.lit("")
    marked = df.withColumn(REASON, F.nullif(reason, F.lit("")))
    return marked.withColumn(STATUS, F.when(F.col(REASON).isNull(), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)))


def observed(df: DataFrame, schema: StructType | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of their number and of the nulls in each required field.

    It is filled by the action that runs the plan, without another pass. Put it behind the
    last shuffle: map tasks that run again after an executor was lost count twice, those of
    the last stage do not.
    """
    observation = Observation()
    figures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    if STATUS in df.columns:
        figures.append(F.count(F.when(F.col(STATUS) == REJECTED, F.lit(1))).alias("rejected"))
    for name in required_fields(schema):
        figures.append(F.count(F.when(F.col(quoted(name)).isNull(), F.lit(1))).alias(f"nulls:{name}"))
    return df.observe(observation, *figures), observation


def accepted(df: DataFrame) -> DataFrame:
    """The accepted rows of a checked dataset that was read whole; one partition is read."""
    kept = [c for c in df.columns if c not in (STATUS, REASON, RECORD, RECORD_FILE)]
    return df.filter(F.col(STATUS) == ACCEPTED).select(*map(quoted, kept))


def stored_schema(spark: SparkSession, schema: StructType | None, malformed: bool) -> Any:
    """The schema of the files of a checked dataset with a declared schema."""
    if schema is None:
        return None
    own = StructType([type(f)(f.name, f.dataType) for f in schema])
    for name in ((RECORD, RECORD_FILE) if malformed else ()):
        own = own.add(name, "string")
    return own.add(REASON, "string").add(STATUS, "string")
