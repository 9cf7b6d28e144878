"""Batch scans."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from millrace.sinks.checked import RECORD, RECORD_FILE, accepted, stored_schema
from millrace.sinks.versions import current_path
from millrace.sources.jdbc import read_jdbc
from millrace.sources.spec import DatasetSpec


def read_dataset(spark: SparkSession, spec: Mapping[str, Any] | DatasetSpec) -> DataFrame:
    """Scan the dataset that ``spec`` describes.

    ``format`` is any batch format the session knows: parquet, orc, csv, json,
    text, jdbc, or a ``pyspark.sql.datasource.DataSource`` that was registered
    with ``spark.dataSource.register``.

    With a declared schema nothing is read until the query runs. Without one,
    csv and json take a full extra pass over the data to infer it, so declare
    the schema of large text datasets.

    Of a ``versioned`` dataset the version published last is read, of one with
    ``violations`` ``reject`` the accepted rows. With ``malformed`` a csv or json scan gives
    records that it cannot read a row as well: with the text in ``malformed_record`` and the
    file it stands in in ``malformed_file``, which are null in all other rows.
    """
    spec = DatasetSpec.of(spec)
    if spec.format.lower() == "jdbc":
        return read_jdbc(spark, spec)
    if spec.violations == "reject":
        return accepted(read_checked(spark, spec))
    if spec.malformed:
        return _with_malformed(spark, spec)
    path = current_path(spark, spec.path) if spec.versioned else spec.path
    return spark.read.options(**spec.options).load(path, spec.format, spec.schema)


def read_checked(spark: SparkSession, spec: Mapping[str, Any] | DatasetSpec) -> DataFrame:
    """All rows of a dataset written with ``violations`` ``reject``: ``row_status`` is ``accepted`` or
    ``rejected``, ``rejected_for`` says why. A filter on the status reads one of the two alone."""
    spec = DatasetSpec.of(spec)
    path = current_path(spark, spec.path) if spec.versioned else spec.path
    reader = spark.read.options(**spec.options)
    if spec.format.lower() in ("csv", "json") and spec.schema is not None:
        reader = reader.schema(stored_schema(spark, spec.schema, spec.malformed))
    return reader.load(path, spec.format)


def _with_malformed(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    options = {k: v for k, v in spec.options.items() if k.lower() not in ("mode", "columnnameofcorruptrecord")}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    # Required fields are the concern of the write; here they would turn a malformed record's nulls into errors.
    schema = StructType([StructField(f.name, f.dataType) for f in spec.schema]).add(RECORD, "string")
    rows = spark.read.options(**options).load(spec.path, spec.format, schema)
    return rows.withColumn(RECORD_FILE, F.when(F.col(RECORD).isNotNull(), F.col("_metadata.file_path")))


def stream_log(path: str) -> str:
    """Where a file stream keeps the list of its files; readers of the folder see those and no others."""
    return f"{path.rstrip('/')}/_spark_metadata"
