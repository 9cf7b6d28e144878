import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from millrace import build_job, rows_frame, run_job, write_dataset

COLUMNS = ["id", "name", "value", "event_date"]
ROWS = [(1, "quartz vein", 12.5, "2021-06-07"), (2, "Feldspar", 80.0, "2021-06-08"), (3, None, 0.0, "2021-06-08")]


@pytest.fixture
def job(spark, folder):
    source = {"path": f"{folder}/in", "format": "csv", "options": {"header": "true", "inferSchema": "true"}}
    write_dataset(rows_frame(spark, ROWS, COLUMNS), {**source, "mode": "overwrite"})
    return {
        "job_name": "sample",
        "source_data": source,
        "destination_data": {"path": f"{folder}/out", "format": "parquet", "mode": "overwrite"},
    }


def output(spark, job):
    return spark.read.parquet(job["destination_data"]["path"]).orderBy("id")


def test_end_to_end(spark, job):
    assert run_job(spark, job) is True
    assert glob.glob(f"{job['destination_data']['path']}/*.parquet")
    uppers = [(r.id, r.name_upper) for r in output(spark, job).collect()]
    assert uppers == [(1, "QUARTZ VEIN"), (2, "FELDSPAR"), (3, None)]
    assert run_job(spark, job) is True and output(spark, job).count() == 3


def test_declared_schema_reads_the_source_once(spark, job):
    job["source_data"]["schema_definition"] = {"id": "integer", "name": "string", "value": "double", "event_date": "date"}
    group = f"once-{job['destination_data']['path']}"
    spark.sparkContext.setJobGroup(group, "job")
    try:
        assert run_job(spark, job)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    assert output(spark, job).dtypes[3] == ("event_date", "date")


def test_partitioned_destination(spark, job):
    job["destination_data"]["partition_by"] = "event_date"
    assert run_job(spark, job)
    assert output(spark, job).columns == ["id", "name", "value", "name_upper", "event_date"]
    assert len(glob.glob(f"{job['destination_data']['path']}/event_date=*")) == 2


def test_destination_options_reach_the_writer(spark, job):
    job["destination_data"]["options"] = {"compression": "gzip"}
    assert run_job(spark, job)
    assert glob.glob(f"{job['destination_data']['path']}/*.gz.parquet")


def test_inspect_prints_both_sides(spark, job, capfd):
    assert run_job(spark, job, inspect=True)
    out = capfd.readouterr().out
    assert out.count("root") == 2 and "QUARTZ VEIN" in out


def test_own_transforms_run_in_order(spark, job):
    steps = [lambda df: df.withColumn("x", F.col("value") + 1), lambda df: df.withColumn("x", F.col("x") * 2)]
    assert run_job(spark, job, steps)
    assert [r.x for r in output(spark, job).collect()] == [27.0, 162.0, 2.0]
    assert "name_upper" not in output(spark, job).columns


def test_no_transforms(spark, job):
    assert run_job(spark, job, [])
    assert output(spark, job).columns == COLUMNS


def test_missing_name_column_passes_through(spark, job, folder):
    job["source_data"] = {"path": f"{folder}/ids", "format": "parquet"}
    write_dataset(spark.range(3), job["source_data"])
    assert run_job(spark, job)
    assert [tuple(r) for r in output(spark, job).collect()] == [(0,), (1,), (2,)]


def test_failures_are_false_and_logged(spark, job, folder, caplog):
    assert not run_job(spark, {**job, "source_data": {"path": f"{folder}/none", "format": "csv"}})
    assert not run_job(spark, {**job, "source_data": {"format": "csv"}})
    assert not run_job(spark, {"source_data": job["source_data"]})
    assert not run_job(spark, {**job, "destination_data": {**job["destination_data"], "mode": "replace"}})
    assert not run_job(spark, job, [lambda df: df.withColumn("x", F.col("nope"))])
    assert "PATH_NOT_FOUND" in caplog.text and "job sample failed" in caplog.text


def test_a_failure_while_rows_flow_is_false_too(spark, job):
    failing = [lambda df: df.withColumn("x", F.raise_error(F.lit("bad row")))]
    assert not run_job(spark, job, failing)


def test_existing_destination_is_kept(spark, job):
    job["destination_data"]["mode"] = "errorifexists"
    assert run_job(spark, job)
    assert not run_job(spark, job, [lambda df: df.limit(1)])
    assert output(spark, job).count() == 3


@pytest.mark.parametrize("inside", ["", "/part"])
def test_overwriting_the_source_is_refused(spark, job, inside):
    path = job["source_data"]["path"]
    job["destination_data"] = {"path": f"file:{path}{inside}", "format": "csv", "mode": "overwrite"}
    assert not run_job(spark, job)
    assert spark.read.csv(path, header=True).count() == 3


def test_appending_to_the_source_is_allowed(spark, job):
    job["destination_data"] = {**job["source_data"], "mode": "append"}
    assert run_job(spark, job, [])
    assert spark.read.csv(job["source_data"]["path"], header=True).count() == 6


def test_parameters_filter_only_with_a_column(spark, job):
    job["parameters"] = {"processing_date": "today", "filter_threshold": 50}
    assert build_job(spark, job).count() == 3
    job["parameters"]["threshold_column"] = "value"
    assert [r.id for r in build_job(spark, job).collect()] == [2]
    assert build_job(spark, job, parameters={"filter_threshold": 12.5}).count() == 2


def test_processing_date(spark, job):
    job["parameters"] = {"processing_date": "today", "date_column": "event_date"}
    assert build_job(spark, job).count() == 0
    override = {"processing_date": "2021-06-08"}
    assert sorted(r.id for r in build_job(spark, job, parameters=override).collect()) == [2, 3]
    assert build_job(spark, job, parameters={"processing_date": dt.date(2021, 6, 7)}).count() == 1


def test_a_daily_run_can_be_repeated(spark, job):
    job["source_data"]["schema"] = "id INT, name STRING, value DOUBLE, event_date DATE"
    job["parameters"] = {"processing_date": "today", "date_column": "event_date"}
    job["destination_data"] |= {"partition_by": "event_date", "options": {"partitionOverwriteMode": "dynamic"}}
    for date in ("2021-06-07", "2021-06-08", "2021-06-08", "2021-06-07"):
        assert run_job(spark, job, parameters={"processing_date": date})
    assert [r.id for r in output(spark, job).collect()] == [1, 2, 3]


def test_a_failed_dynamic_overwrite_keeps_the_old_rows(spark, job):
    job["destination_data"] |= {"partition_by": "event_date", "options": {"partitionOverwriteMode": "dynamic"}}
    assert run_job(spark, job)
    failing = [lambda df: df.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("bad row"))))]
    assert not run_job(spark, job, failing)
    assert [r.name_upper for r in output(spark, job).collect()] == ["QUARTZ VEIN", "FELDSPAR", None]


def test_the_plan_shuffles_nothing(spark, job):
    job["source_data"]["schema"] = "id INT, name STRING, value DOUBLE, event_date DATE"
    plan = build_job(spark, job)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_filters_reach_the_scan(spark, job):
    job["source_data"]["schema"] = "id INT, name STRING, value DOUBLE, event_date DATE"
    job["parameters"] = {"filter_threshold": 50, "threshold_column": "value"}
    plan = build_job(spark, job).select("name_upper")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,50" in plan
    assert "ReadSchema: struct<name:string,value:double>" in plan
