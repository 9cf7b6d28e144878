"""Batch writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.operators.columns import quoted
from millrace.sinks.checked import STATUS, observed, required_fields, with_status
from millrace.sinks.runs import finish_run, run_path, staging_path
from millrace.sinks.versions import new_version, publish, published
from millrace.sources.files import stream_log
from millrace.sources.jdbc import write_jdbc
from millrace.sources.spec import DatasetSpec
from millrace.sources.storage import path_exists

# CSV and JSON cut timestamps to milliseconds unless they are told these.
_MICROSECONDS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_dataset(
    df: DataFrame, spec: Mapping[str, Any] | DatasetSpec, figures: dict[str, Any] | None = None
) -> None:
    """Write ``df`` to the dataset that ``spec`` describes.

    ``mode`` is one of Spark's save modes, ``errorifexists`` unless given. CSV and
    JSON keep microseconds of timestamps unless the options name another format.
    Appending to the output of a file stream is refused: readers of such a folder
    see only what the stream wrote.

    ``versioned`` in a spec makes an overwrite a new version, which readers see when it is
    whole. ``run_id`` makes an append one that may be repeated: it replaces the rows of the
    same run. ``violations`` checks the required fields of the declared schema in the same
    pass: ``reject`` keeps rows that lack one, and malformed records, aside in a partition
    of their own, ``fail`` ends the write (of a version or a run, nothing is seen of it then).

    ``figures`` is filled with the number of rows written and, if the schema declares
    required fields, the nulls in each and the rows rejected; the write itself counts them.
    """
    spec = DatasetSpec.of(spec)
    if spec.format.lower() == "jdbc":
        write_jdbc(df, spec)
        return
    spark = df.sparkSession
    if spec.save_mode.lower() == "append" and isinstance(spec.path, str):
        if path_exists(spark, stream_log(spec.path)):
            raise ValueError(f"{spec.path} is the output of a stream; rows appended to it would not be seen")
    partition_by, schema = list(spec.partition_by), spec.schema if spec.violations or figures is not None else None
    if spec.violations == "reject":
        df = with_status(df, schema)
        partition_by = [STATUS, *partition_by]
    dealt = clustered(rebalanced(df, spec, partition_by), spec, partition_by)
    if spec.violations == "fail":
        dealt = dealt.select(*(_required(field) for field in _declared(dealt, schema)))
    observation = None
    if figures is not None:
        dealt, observation = observed(dealt, schema)
    writer = dealt.write.options(**writer_options(spec))
    if spec.versioned:
        before = published(spark, spec.path)
        version, path = new_version(spec.path)
        writer.save(path, spec.format, "errorifexists", partition_by or None)
        publish(spark, spec.path, version, before)
    elif spec.run_id:
        # An id that cannot be a folder's name is refused before anything runs.
        run_path(spec.path, spec.run_id)
        staged = staging_path(spec.path)
        writer.save(staged, spec.format, "errorifexists", partition_by or None)
        finish_run(spark, staged, spec.path, spec.run_id)
    else:
        writer.save(spec.path, spec.format, spec.save_mode, partition_by or None)
    if observation is not None:
        figures.update(observation.get)


def _declared(df: DataFrame, schema: StructType | None) -> list[tuple[str, bool]]:
    required = {name.lower() for name in required_fields(schema)}
    return [(name, name.lower() in required) for name in df.columns]


def _required(field: tuple[str, bool]) -> Column:
    name, needed = field
    value = F.col(quoted(name))
    if not needed:
        return value
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"required field {name} is null"))).alias(name)


def writer_options(spec: DatasetSpec) -> dict[str, Any]:
    if spec.format.lower() not in ("csv", "json"):
        return spec.options
    return {**{k: v for k, v in _MICROSECONDS.items() if spec.option(k) is None}, **spec.options}


def clustered(df: DataFrame, spec: DatasetSpec, partition_by: Sequence[str]) -> DataFrame:
    """Sort the rows of each task by ``sort_by``, within its output partitions.

    A parquet or ORC file then has a narrow range of those columns in each row group or
    stripe, and a scan with a bound on them reads few. Nothing is shuffled for it.
    """
    if not spec.sort_by:
        return df
    return df.sortWithinPartitions(*(F.col(quoted(name)) for name in [*partition_by, *spec.sort_by]))


def rebalanced(df: DataFrame, spec: DatasetSpec, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Bring the rows of each output partition together before a partitioned write.

    Without this every task writes a file into every partition it has rows for:
    tasks times partition values files. A plain ``repartition`` by the same
    columns would put all rows of a hot value into one task. ``REBALANCE`` does
    neither: adaptive execution splits a large shuffle partition into pieces of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and merges small ones.

    That size is counted in compressed bytes, of which many copies of a row take
    few. So each value is also dealt out over ``rebalance`` shuffle partitions, 4
    unless the spec says otherwise, by the number of the input partition, which a
    repeated task has again. That is up to so many times the files where values
    are small; ``"rebalance": 1`` in a spec deals nothing out.

    With adaptive execution off Spark leaves the shuffle out, and each task
    writes what it has. ``"rebalance": False`` in a spec does the same: for input
    that already lies in partition order, for a few values with very many rows,
    or to keep the order of a sort before the write, which the shuffle would undo.
    """
    partition_by = spec.partition_by if partition_by is None else partition_by
    if not partition_by or not spec.rebalance:
        return df
    values = [F.col(quoted(name)) for name in partition_by]
    if spec.rebalance == 1:
        return df.hint("rebalance", *values)
    deal = _unused_name(df)
    dealt = df.withColumn(deal, F.spark_partition_id() % spec.rebalance)
    return dealt.hint("rebalance", *values, F.col(deal)).drop(deal)


def _unused_name(df: DataFrame) -> str:
    taken, name = {column.lower() for column in df.columns}, "__deal"
    while name in taken:
        name += "_"
    return name
