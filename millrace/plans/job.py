"""A job: one source, a list of transforms, one destination."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.dates import resolve_run_dates
from millrace.operators.columns import upper_column
from millrace.operators.filters import filter_processing_date, filter_processing_dates, filter_threshold
from millrace.operators.ordering import show_sample
from millrace.plans.catalog import DatasetCatalog
from millrace.sinks.checked import observed
from millrace.sinks.files import write_dataset
from millrace.sources.files import read_dataset
from millrace.sources.paths import overlap
from millrace.sources.spec import DatasetSpec

log = logging.getLogger(__name__)

Transform = Callable[[DataFrame], DataFrame]

# What a job does when it is given no transforms.
DEFAULT_TRANSFORMS: tuple[Transform, ...] = (upper_column("name"),)


def run_job(
    spark: SparkSession,
    job: Mapping[str, Any],
    transforms: Iterable[Transform] | None = None,
    parameters: Mapping[str, Any] | None = None,
    catalog: DatasetCatalog | None = None,
    inspect: bool = False,
    figures: dict[str, Any] | None = None,
) -> bool:
    """Run a job and say whether it succeeded; a failure is logged, not raised.

    ``job`` holds ``source_data``, ``destination_data`` and optionally
    ``parameters``; ``parameters`` given here override those. The source is read
    once, by the write. ``inspect=True`` also prints the schema and five rows
    before and after the transforms, at the price of reading them again.

    ``figures`` is filled with what the one pass has counted: ``rows_read`` before the
    transforms, and what ``write_dataset`` counts. All rows are read for that: filters do
    not pass the count. Where a transform shuffles, ``rows_read`` may count tasks twice
    that ran again after an executor was lost.
    """
    try:
        source, destination = job_specs(job, catalog)
        # A new version, or the rows of a run, leave what is read as it is.
        replaces = destination.save_mode.lower() == "overwrite" and not destination.versioned
        if replaces and overlap(source, destination):
            raise ValueError(f"overwriting {destination.path or 'the table'} would delete the data being read")
        rows, read = read_dataset(spark, source), None
        if figures is not None:
            rows, read = observed(rows)
        result = apply_transforms(rows, transforms, merged_parameters(job, parameters))
        if inspect:
            show_sample(rows)
            show_sample(result)
        write_dataset(result, destination, figures)
        if read is not None:
            figures["rows_read"] = read.get["rows"]
    except Exception:
        log.exception("job %s failed", job.get("job_name", ""))
        return False
    return True


def build_job(
    spark: SparkSession,
    job: Mapping[str, Any],
    transforms: Iterable[Transform] | None = None,
    parameters: Mapping[str, Any] | None = None,
    catalog: DatasetCatalog | None = None,
) -> DataFrame:
    """The rows a job would write, as a plan that has not run."""
    source = DatasetSpec.of(_resolved(job.get("source_data"), catalog))
    return apply_transforms(read_dataset(spark, source), transforms, merged_parameters(job, parameters))


def job_specs(job: Mapping[str, Any], catalog: DatasetCatalog | None) -> tuple[DatasetSpec, DatasetSpec]:
    """Source and destination; either may name a ``dataset_id`` of the catalog."""
    source = _resolved(job.get("source_data"), catalog)
    destination = _resolved(job.get("destination_data"), catalog)
    return DatasetSpec.of(source), DatasetSpec.of(destination)


def merged_parameters(job: Mapping[str, Any], overrides: Mapping[str, Any] | None) -> dict[str, Any]:
    return {**(job.get("parameters") or {}), **(overrides or {})}


def apply_transforms(
    rows: DataFrame, transforms: Iterable[Transform] | None, parameters: Mapping[str, Any]
) -> DataFrame:
    """Apply the filters that ``parameters`` ask for, then the transforms.

    ``filter_threshold`` works on the column named by ``threshold_column`` and
    ``processing_date``, a day, a list of days or ``{"from": ..., "to": ...}``, on the one
    named by ``date_column``. Without a column
    they are left to the transforms and filter nothing here.
    """
    steps: list[Transform] = []
    if parameters.get("threshold_column"):
        steps.append(filter_threshold(parameters["threshold_column"], parameters["filter_threshold"]))
    if parameters.get("date_column"):
        days, column = resolve_run_dates(rows.sparkSession, parameters["processing_date"]), parameters["date_column"]
        steps.append(filter_processing_date(column, days[0]) if len(days) == 1 else filter_processing_dates(column, days))
    for step in [*steps, *(DEFAULT_TRANSFORMS if transforms is None else transforms)]:
        rows = rows.transform(step)
    return rows


def _resolved(spec: Mapping[str, Any] | None, catalog: DatasetCatalog | None) -> Mapping[str, Any]:
    if not spec:
        raise ValueError("a job needs 'source_data' and 'destination_data'")
    if not spec.get("dataset_id"):
        return spec
    if catalog is None:
        raise ValueError(f"no catalog to look up dataset {spec['dataset_id']!r}")
    return catalog.resolve(spec)
