"""The same jobs over Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.catalog import DatasetCatalog
from millrace.plans.job import Transform, apply_transforms, job_specs, merged_parameters
from millrace.sinks.files import rebalanced, write_dataset, writer_options
from millrace.sources.files import stream_log
from millrace.sources.paths import overlap
from millrace.sources.spec import DatasetSpec
from millrace.sources.storage import has_files, path_exists

log = logging.getLogger(__name__)

_FILE_FORMATS = frozenset({"parquet", "orc", "csv", "json", "text"})


def read_stream(spark: SparkSession, spec: Mapping[str, Any] | DatasetSpec) -> DataFrame:
    """Read the dataset as a stream.

    A file stream needs a declared schema. ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` in the options bounds one micro-batch. Other formats,
    such as kafka, are passed through and need their package on the cluster.
    """
    spec = DatasetSpec.of(spec)
    if spec.format.lower() in _FILE_FORMATS and not spec.schema:
        raise ValueError(f"a {spec.format} stream needs a declared schema")
    return spark.readStream.options(**spec.options).load(spec.path, spec.format, spec.schema)


def write_stream(
    df: DataFrame, spec: Mapping[str, Any] | DatasetSpec, trigger: Mapping[str, Any] | None = None
) -> StreamingQuery:
    """Start writing a stream and return the running query.

    The options must name a ``checkpointLocation`` on storage that outlives the
    driver: with it a restarted query goes on where the last one stopped, and
    the file sink holds each row once. ``trigger`` is passed to Spark; the
    default handles all that is there and then stops.

    A file stream hides what others put into its folder, and skips batches that the
    folder's log already has. So a folder with files of a batch job is refused,
    and so is another stream's output under a new checkpoint. With the mode
    ``errorifexists`` given, any folder is refused that this checkpoint did not begin.

    With a ``run_id`` each micro-batch is a run of the dataset (see ``write_dataset``)
    instead, which batch readers and batch jobs share.
    """
    spec = DatasetSpec.of(spec)
    checkpoint = spec.option("checkpointLocation")
    if not checkpoint:
        raise ValueError("a stream needs the option 'checkpointLocation'")
    if spec.run_id:
        return _write_batches(df, spec, trigger)
    if spec.versioned or spec.violations:
        raise ValueError("a stream has no versions, and checks rows only with a 'run_id'")
    mode = (spec.mode or "append").lower()
    if mode not in ("append", "errorifexists"):
        raise ValueError(f"a stream can only append, not {spec.mode}")
    if spec.format.lower() in _FILE_FORMATS:
        _check_destination(df.sparkSession, spec.path, checkpoint, mode)
    query = rebalanced(df, spec).writeStream.options(**writer_options(spec)).trigger(**(trigger or {"availableNow": True}))
    return query.start(spec.path, spec.format, "append", list(spec.partition_by) or None)


def _write_batches(df: DataFrame, spec: DatasetSpec, trigger: Mapping[str, Any] | None) -> StreamingQuery:
    """Write each micro-batch as a run of its own, ``<run_id>-<batch number>``.

    Spark repeats a batch that was written but not yet committed, under the same number;
    it then replaces its own rows. All that a batch write can do works here too:
    required fields, figures, sorted files. ``run_id`` names the stream: give a new
    checkpoint a new one, as its numbers begin at zero again.
    """
    options = {k: v for k, v in spec.options.items() if k.lower() != "checkpointlocation"}

    def write(batch: DataFrame, number: int) -> None:
        write_dataset(batch, replace(spec, run_id=f"{spec.run_id}-{number:08d}", options=options))

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", spec.option("checkpointLocation"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _check_destination(spark: SparkSession, path: str, checkpoint: str, mode: str) -> None:
    if path_exists(spark, stream_log(path)):
        if not path_exists(spark, checkpoint):
            raise ValueError(f"{path} is the output of a stream with another checkpoint")
    elif has_files(spark, path):
        raise ValueError(f"{path} holds files that a stream into it would hide")
    elif mode == "errorifexists" and path_exists(spark, path):
        raise ValueError(f"{path} exists")


def run_stream_job(
    spark: SparkSession,
    job: Mapping[str, Any],
    transforms: Iterable[Transform] | None = None,
    parameters: Mapping[str, Any] | None = None,
    catalog: DatasetCatalog | None = None,
) -> bool:
    """Process all data that has arrived since the last run; ``False`` on failure.

    Takes the same job description and transforms as ``run_job``.
    """
    try:
        source, destination = job_specs(job, catalog)
        if overlap(source, destination):
            raise ValueError("a stream cannot write where it reads")
        rows = apply_transforms(read_stream(spark, source), transforms, merged_parameters(job, parameters))
        query = write_stream(rows, destination)
        try:
            query.awaitTermination()
        finally:
            # Has ended, unless the wait was interrupted.
            query.stop()
    except Exception:
        log.exception("stream job %s failed", job.get("job_name", ""))
        return False
    return True
