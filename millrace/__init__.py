"""Config-driven data jobs written with the Spark DataFrame API.

A dataset is described by a plain mapping (path, format, schema, options, ...).
``read_dataset`` and ``write_dataset`` turn such a mapping into a scan or a
write, a transform is any ``DataFrame -> DataFrame`` function, and ``run_job``
puts the three together. Everything in between is Spark's own logical plan.
"""

from millrace.functions.dates import resolve_run_date, resolve_run_dates
from millrace.functions.schema import to_struct
from millrace.operators.checks import required_field_violations
from millrace.operators.columns import upper_column
from millrace.operators.filters import filter_processing_date, filter_processing_dates, filter_threshold
from millrace.operators.ordering import count_rows, preview, show_sample, sort_rows
from millrace.plans.catalog import DatasetCatalog
from millrace.plans.job import build_job, run_job
from millrace.sinks.files import write_dataset
from millrace.sinks.scratch import scratch_dir
from millrace.sinks.versions import expire_versions, release_claim
from millrace.sources.files import read_checked, read_dataset
from millrace.sources.generations import read_generations
from millrace.sources.rows import rows_frame
from millrace.sources.spec import DatasetSpec
from millrace.streaming.job import read_stream, run_stream_job, write_stream

__all__ = [
    "DatasetCatalog",
    "DatasetSpec",
    "build_job",
    "count_rows",
    "expire_versions",
    "filter_processing_date",
    "filter_processing_dates",
    "filter_threshold",
    "preview",
    "read_checked",
    "read_dataset",
    "read_generations",
    "read_stream",
    "release_claim",
    "required_field_violations",
    "resolve_run_date",
    "resolve_run_dates",
    "rows_frame",
    "run_job",
    "run_stream_job",
    "scratch_dir",
    "show_sample",
    "sort_rows",
    "to_struct",
    "upper_column",
    "write_dataset",
    "write_stream",
]
