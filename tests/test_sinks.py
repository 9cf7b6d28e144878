import glob
import os
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace import DatasetSpec, read_dataset, scratch_dir, sort_rows, write_dataset


def data_files(folder):
    return [p for p in glob.glob(f"{folder}/**/part-*", recursive=True)]


def files_per_partition(folder):
    return Counter(os.path.basename(os.path.dirname(p)) for p in data_files(folder))


@pytest.mark.parametrize("mode, expected", [("overwrite", [1]), ("append", [0, 1]), ("ignore", [0])])
def test_save_modes(spark, folder, mode, expected):
    spec = {"path": folder, "format": "parquet"}
    write_dataset(spark.range(0, 1), spec)
    write_dataset(spark.range(1, 2), {**spec, "mode": mode})
    assert sorted(r.id for r in read_dataset(spark, spec).collect()) == expected


def test_the_default_mode_refuses_an_existing_place(spark, folder):
    spec = {"path": folder, "format": "parquet"}
    write_dataset(spark.range(1), spec)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_dataset(spark.range(1), spec)


def test_the_default_mode_refuses_an_empty_folder(spark, folder):
    os.makedirs(folder)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_dataset(spark.range(1), {"path": folder, "format": "parquet"})


def test_unknown_mode(spark, folder):
    with pytest.raises(Exception, match="INVALID_SAVE_MODE"):
        write_dataset(spark.range(1), {"path": folder, "format": "parquet", "mode": "replace"})


@pytest.mark.parametrize("partition_by", ["day", ["day"], ("day", "kind")])
def test_partitioned(spark, folder, partition_by):
    df = spark.range(100).select("id", F.expr("id % 3 AS day"), F.expr("id % 2 AS kind"))
    spec = {"path": folder, "format": "parquet", "partition_by": partition_by}
    write_dataset(df, spec)
    assert {os.path.basename(p) for p in glob.glob(f"{folder}/day=*")} == {"day=0", "day=1", "day=2"}
    back = read_dataset(spark, {**spec, "schema": "id BIGINT, day BIGINT, kind BIGINT"})
    assert back.select("id", "day", "kind").exceptAll(df).isEmpty()
    assert back.count() == 100


def test_overwriting_single_partitions(spark, folder):
    """With Spark's dynamic mode a run replaces the partitions it writes and no others."""
    spec = {"path": folder, "format": "parquet", "mode": "overwrite", "partition_by": "day"}
    write_dataset(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, day)"), spec)
    rerun = {**spec, "options": {"partitionOverwriteMode": "dynamic"}}
    write_dataset(spark.sql("SELECT 3 AS id, 'b' AS day"), rerun)
    assert sorted(map(tuple, read_dataset(spark, spec).collect())) == [(1, "a"), (3, "b")]
    write_dataset(spark.sql("SELECT 4 AS id, 'c' AS day"), spec)
    assert [tuple(r) for r in read_dataset(spark, spec).collect()] == [(4, "c")]


def test_unknown_partition_column(spark, folder):
    with pytest.raises(AnalysisException):
        write_dataset(spark.range(1), {"path": folder, "format": "parquet", "partition_by": "nope"})


def test_odd_partition_column_names(spark, folder):
    df = spark.range(4).select("id", (F.col("id") % 2).alias("a.b`c"))
    write_dataset(df, {"path": folder, "format": "parquet", "partition_by": "a.b`c"})
    assert spark.read.parquet(folder).count() == 4


def test_partitions_are_brought_together(spark, folder):
    """One file per value, not one per task and value."""
    df = spark.range(0, 4000, 1, 8).select("id", F.expr("id % 10 AS day"))
    spec = {"format": "parquet", "partition_by": "day"}
    write_dataset(df, {**spec, "path": f"{folder}/on", "rebalance": 1})
    write_dataset(df, {**spec, "path": f"{folder}/off", "rebalance": False})
    assert set(files_per_partition(f"{folder}/on").values()) == {1}
    assert set(files_per_partition(f"{folder}/off").values()) == {8}


def test_without_rebalance_a_sort_is_kept(spark, folder):
    df = sort_rows(spark.range(0, 3000, 1, 4).select((2999 - F.col("id")).alias("id"), F.lit("x").alias("day")), "id")
    write_dataset(df, {"path": folder, "format": "parquet", "partition_by": "day", "rebalance": False})
    for path in data_files(folder):
        ids = [r.id for r in spark.read.parquet(path).collect()]
        assert ids == sorted(ids)


def test_a_hot_value_is_spread_over_tasks(spark, folder, conf):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 20))
    df = spark.range(0, 90000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), hot.alias("day"))
    write_dataset(df, {"path": folder, "format": "parquet", "partition_by": "day"})
    files = files_per_partition(folder)
    assert files["day=hot"] >= 6
    back = read_dataset(spark, {"path": folder, "format": "parquet"})
    assert back.count() == 90000 and back.select("id").distinct().count() == 90000


def test_copies_of_a_row_are_spread_although_they_compress_well(spark, folder):
    """Far below the advisory size, yet not one task's work."""
    copies = spark.range(0, 400000, 1, 8).select(F.lit("same text " * 10).alias("text"), F.lit("hot").alias("day"))
    others = spark.range(0, 400000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 512).alias("text"), F.concat(F.lit("d"), F.col("id") % 20).alias("day")
    )
    spec = {"path": folder, "format": "parquet", "partition_by": "day"}
    write_dataset(copies.union(others), spec)
    files = files_per_partition(folder)
    assert 1 < files["day=hot"] <= 4 and max(files.values()) <= 4
    back = read_dataset(spark, {"path": folder, "format": "parquet"})
    assert back.columns == ["text", "day"]
    assert back.count() == 800000 and back.filter("day = 'hot'").count() == 400000


def test_a_column_of_any_name_is_written(spark, folder):
    df = spark.range(40).selectExpr("id", "id % 3 AS day", "id * 2 AS __deal", "id * 3 AS __DEAL_")
    write_dataset(df, {"path": folder, "format": "parquet", "partition_by": "day"})
    back = read_dataset(spark, {"path": folder, "format": "parquet"})
    assert back.columns == ["id", "__deal", "__DEAL_", "day"]
    assert back.agg(F.sum("__deal"), F.sum("__DEAL_")).first() == (2 * 780, 3 * 780)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_a_given_timestamp_format_is_kept(spark, folder, fmt):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS ts")
    write_dataset(df, {"path": folder, "format": fmt, "options": {"timestampNTZformat": "yyyy/MM/dd"}})
    assert "2024/01/02" in open(data_files(folder)[0]).read()


def test_rebalance_settings():
    def pieces(**entry):
        return DatasetSpec.of({"path": "/x", "format": "csv", **entry}).rebalance

    assert pieces() == pieces(rebalance=True) == 4
    assert pieces(rebalance=False) == pieces(rebalance=0) == pieces(rebalance=None) == 0
    assert pieces(rebalance=16) == 16


def test_without_adaptive_execution_no_task_takes_a_whole_value(spark, folder, conf):
    conf("spark.sql.adaptive.enabled", "false")
    df = spark.range(0, 4000, 1, 8).select("id", F.lit("hot").alias("day"))
    write_dataset(df, {"path": folder, "format": "parquet", "partition_by": "day"})
    assert files_per_partition(folder)["day=hot"] == 8
    assert read_dataset(spark, {"path": folder, "format": "parquet"}).count() == 4000


@pytest.mark.parametrize(
    "fmt, compression, ending",
    [
        ("parquet", "gzip", ".gz.parquet"),
        ("parquet", "snappy", ".snappy.parquet"),
        ("orc", "zlib", ".zlib.orc"),
        ("csv", "gzip", ".csv.gz"),
        ("json", "gzip", ".json.gz"),
    ],
)
def test_writer_options(spark, folder, fmt, compression, ending):
    write_dataset(spark.range(3), {"path": folder, "format": fmt, "options": {"compression": compression}})
    assert data_files(folder) and all(p.endswith(ending) for p in data_files(folder))


def test_header_option_is_applied(spark, folder):
    write_dataset(spark.range(1), {"path": folder, "format": "csv", "options": {"header": True}})
    assert open(data_files(folder)[0]).readline() == "id\n"


class FakeSession:
    def __init__(self, **conf):
        self._conf = {k.replace("_", "."): v for k, v in conf.items()}

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self._conf.get(key, default)


def test_scratch_dir_is_new_and_shared():
    session = FakeSession(spark_master="yarn", spark_checkpoint_dir="hdfs://nn/shared/")
    one, two = scratch_dir(session), scratch_dir(session)
    assert one != two and one.startswith("hdfs://nn/shared/run-")


def test_scratch_dir_without_a_shared_folder():
    assert os.path.isdir(scratch_dir(FakeSession(spark_master="local[4]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession(spark_master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession(spark_master="local-cluster[2,1,1024]"))
