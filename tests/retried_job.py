"""Run jobs in which every task fails at its first attempt; used by test_retries.

A session of its own is needed, since local mode retries tasks only when the
master says so.
"""

import glob
import sys

from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F

from millrace import run_job, run_stream_job, sort_rows


def fail_once(batches):
    """Hand on the rows, then fail at the first attempt, after part of the output is written."""
    yield from batches
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")


def unreliable(df):
    return df.mapInPandas(fail_once, df.schema)


def main(folder):
    spark = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    rows = spark.range(0, 20000, 1, 6).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.expr("IF(id % 3 = 0, 0, id % 5) AS day")
    )
    rows.write.parquet(f"{folder}/in")
    source = {"path": f"{folder}/in", "format": "parquet", "schema": "id LONG, name STRING, day LONG"}

    for name, partition_by in (("flat", None), ("by_day", "day")):
        target = {"path": f"{folder}/{name}", "format": "parquet", "partition_by": partition_by}
        assert run_job(spark, {"source_data": source, "destination_data": target}, [unreliable])
        check(spark.read.parquet(target["path"]))
    assert len(glob.glob(f"{folder}/by_day/day=0/*.parquet")) > 1

    target = {
        "path": f"{folder}/stream",
        "format": "parquet",
        "mode": "append",
        "partition_by": "day",
        "options": {"checkpointLocation": f"{folder}/checkpoint"},
    }
    assert run_stream_job(spark, {"source_data": source, "destination_data": target}, [unreliable])
    check(spark.read.parquet(target["path"]))

    ordered = sort_rows(unreliable(spark.read.parquet(f"{folder}/in")), "day")
    check(ordered)
    days = [r.day for r in ordered.collect()]
    assert days == sorted(days)
    spark.stop()


def check(df):
    assert df.count() == 20000
    assert df.select("id").distinct().count() == 20000


if __name__ == "__main__":
    main(sys.argv[1])
