import glob
import os

import pytest
from pyspark.sql import functions as F

from millrace import read_stream, rows_frame, run_stream_job, upper_column, write_dataset, write_stream

SCHEMA = "id BIGINT, name STRING, day STRING"


def add(spark, folder, *rows):
    write_dataset(rows_frame(spark, rows, SCHEMA), {"path": f"{folder}/in", "format": "json", "mode": "append"})


@pytest.fixture
def job(spark, folder):
    add(spark, folder, (1, "a", "d1"), (2, "b", "d2"))
    return {
        "source_data": {"path": f"{folder}/in", "format": "json", "schema": SCHEMA, "options": {"maxFilesPerTrigger": 1}},
        "destination_data": {
            "path": f"{folder}/out",
            "format": "parquet",
            "mode": "append",
            "options": {"checkpointLocation": f"{folder}/checkpoint"},
        },
    }


def names(spark, folder):
    return sorted(r.name_upper for r in spark.read.parquet(f"{folder}/out").collect())


def test_each_row_arrives_once(spark, folder, job):
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B"]
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B"]
    add(spark, folder, (3, "c", "d1"))
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B", "C"]


def test_partitioned_stream_brings_partitions_together(spark, folder, job):
    rows = [(i, "x", f"d{i % 3}") for i in range(90)]
    write_dataset(rows_frame(spark, rows, SCHEMA).repartition(6), {"path": f"{folder}/many", "format": "json"})
    job["source_data"] = {"path": f"{folder}/many", "format": "json", "schema": SCHEMA}
    job["destination_data"]["partition_by"] = "day"
    assert run_stream_job(spark, job)
    assert len(glob.glob(f"{folder}/out/day=*/*.parquet")) == 3
    assert spark.read.parquet(f"{folder}/out").count() == 90


def test_a_failed_batch_is_done_again(spark, folder, job):
    failing = [upper_column("name"), lambda df: df.withColumn("x", F.raise_error(F.lit("bad row")).cast("string"))]
    assert not run_stream_job(spark, job, failing)
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B"]


def test_parameters(spark, folder, job):
    job["parameters"] = {"filter_threshold": 2, "threshold_column": "id"}
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["B"]


def test_a_stream_does_not_hide_batch_rows(spark, folder, job):
    before = rows_frame(spark, [(9, "old", "d0"), (8, "older", "d0")], SCHEMA)
    write_dataset(before, {"path": f"{folder}/out", "format": "parquet"})
    assert not run_stream_job(spark, job)
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_a_batch_does_not_append_to_a_stream(spark, folder, job):
    assert run_stream_job(spark, job)
    more = rows_frame(spark, [(9, "new", "d0", "NEW")], f"{SCHEMA}, name_upper STRING")
    with pytest.raises(ValueError, match="output of a stream"):
        write_dataset(more, {"path": f"{folder}/out", "format": "parquet", "mode": "append"})
    assert names(spark, folder) == ["A", "B"]


def test_a_new_checkpoint_does_not_skip_batches(spark, folder, job):
    assert run_stream_job(spark, job)
    job["destination_data"]["options"] = {"checkpointLocation": f"{folder}/another"}
    assert not run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B"]


def test_errorifexists(spark, folder, job):
    job["destination_data"]["mode"] = "errorifexists"
    os.makedirs(f"{folder}/out")
    assert not run_stream_job(spark, job)
    os.rmdir(f"{folder}/out")
    assert run_stream_job(spark, job)
    add(spark, folder, (3, "c", "d1"))
    assert run_stream_job(spark, job)
    assert names(spark, folder) == ["A", "B", "C"]


def test_query_handle(spark, folder, job):
    rows = read_stream(spark, job["source_data"])
    assert rows.isStreaming
    query = write_stream(rows.transform(upper_column()), job["destination_data"], {"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        assert query.isActive and names(spark, folder) == ["A", "B"]
    finally:
        query.stop()


def test_requirements(spark, folder, job):
    source, destination = job["source_data"], job["destination_data"]
    with pytest.raises(ValueError, match="schema"):
        read_stream(spark, {**source, "schema": None})
    rows = read_stream(spark, source)
    with pytest.raises(ValueError, match="checkpointLocation"):
        write_stream(rows, {**destination, "options": {}})
    with pytest.raises(ValueError, match="only append"):
        write_stream(rows, {**destination, "mode": "overwrite"})
    assert not run_stream_job(spark, {**job, "destination_data": {**destination, "path": f"{folder}/in/out"}})
    assert not run_stream_job(spark, {**job, "source_data": {**source, "path": f"{folder}/none"}})


def test_other_formats_are_passed_through(spark):
    rate = read_stream(spark, {"format": "rate", "options": {"rowsPerSecond": 1}})
    assert rate.columns == ["timestamp", "value"]
    with pytest.raises(Exception, match="kafka"):
        read_stream(spark, {"format": "kafka", "options": {"subscribe": "t", "kafka.bootstrap.servers": "h:1"}})
