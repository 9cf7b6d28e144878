import datetime as dt
import glob
import os
import pathlib
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from millrace import DatasetSpec, read_dataset, rows_frame, write_dataset
from millrace.sources.paths import overlap

ROWS = [("granite", 1), ("basalt", 2), ("marl", 3)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, folder, fmt):
    spec = {"path": folder, "format": fmt, "schema": "name STRING, id BIGINT"}
    write_dataset(rows_frame(spark, ROWS, ["name", "id"]), spec)
    df = read_dataset(spark, spec)
    assert df.dtypes == [("name", "string"), ("id", "bigint")]
    assert sorted(map(tuple, df.collect())) == sorted(ROWS)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_declared_types_survive(spark, folder, fmt):
    schema = (
        "i INT, l BIGINT, s STRING, d DOUBLE, day DATE, ts TIMESTAMP, ntz TIMESTAMP_NTZ, dec DECIMAL(10,2), b BOOLEAN"
    )
    day = dt.date(1969, 12, 31)
    instant = dt.datetime(2024, 2, 29, 23, 59, 59, 999999)
    rows = [
        (-(2**31), 2**63 - 1, "text", 0.1, day, instant, instant, Decimal("-12345678.90"), True),
        (2**31 - 1, -(2**63), "x,y|z", 1e300, dt.date(2100, 1, 1), instant, instant, Decimal("0.01"), False),
        (None,) * 9,
    ]
    df = rows_frame(spark, rows, schema)
    spec = {"path": folder, "format": fmt, "schema": schema}
    write_dataset(df, spec)
    back = read_dataset(spark, spec)
    assert back.dtypes == df.dtypes
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_awkward_text_survives(spark, folder, fmt):
    pick = random.Random(7)
    alphabet = "ab \t\"'\\,|;\n\r{}[]#é日😀"
    rows = [(i, "".join(pick.choices(alphabet, k=pick.randint(0, 12)))) for i in range(300)]
    options = {
        "multiLine": "true",
        "escape": '"',
        "nullValue": "NULL",
        "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    spec = {"path": folder, "format": fmt, "schema": "i INT, s STRING", "options": options if fmt == "csv" else {}}
    write_dataset(rows_frame(spark, rows, spec["schema"]), spec)
    assert sorted(map(tuple, read_dataset(spark, spec).collect())) == rows


def test_inferred_csv(spark, folder):
    rows = [(1, "slate", 0.25, "2021-03-04"), (2, "chert", 7.5, "2021-03-05")]
    options = {"header": "true", "inferSchema": "true"}
    spec = {"path": folder, "format": "csv", "options": options}
    write_dataset(rows_frame(spark, rows, ["no", "rock", "share", "found"]), spec)
    df = read_dataset(spark, spec)
    assert df.dtypes == [("no", "int"), ("rock", "string"), ("share", "double"), ("found", "date")]
    assert df.orderBy("no").first() == (1, "slate", 0.25, dt.date(2021, 3, 4))


def test_without_inference_csv_is_text(spark, folder):
    spec = {"path": folder, "format": "csv", "options": None, "schema": ""}
    write_dataset(rows_frame(spark, ROWS, ["name", "id"]), spec)
    assert read_dataset(spark, spec).dtypes == [("_c0", "string"), ("_c1", "string")]


def test_csv_options_keep_nulls_apart_from_empty_text(spark, folder):
    rows = [(1, None), (2, ""), (3, 'a "b", c|d\\e'), (4, " padded "), (5, "x\\")]
    options = {"nullValue": "NULL", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    spec = {"path": folder, "format": "csv", "schema": "id INT, text STRING", "options": options}
    write_dataset(rows_frame(spark, rows, "id INT, text STRING"), spec)
    assert sorted(map(tuple, read_dataset(spark, spec).collect())) == rows


def test_malformed_csv_fails_when_told_to(spark, folder):
    spec = {"path": folder, "format": "csv"}
    write_dataset(rows_frame(spark, [("1",), ("two",)], ["id"]), spec)
    assert {r.id for r in read_dataset(spark, {**spec, "schema": "id INT"}).collect()} == {1, None}
    strict = read_dataset(spark, {**spec, "schema": "id INT", "options": {"mode": "FAILFAST"}})
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        strict.collect()


def test_a_schema_is_not_checked_by_reading(spark, folder):
    """A declared schema starts no job."""
    spec = {"path": folder, "format": "csv", "schema": "name STRING, id BIGINT"}
    write_dataset(rows_frame(spark, ROWS, ["name", "id"]), spec)
    spark.sparkContext.setJobGroup("read", "read only")
    read_dataset(spark, spec)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("read")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_several_paths(spark, folder):
    for i, row in enumerate(ROWS):
        write_dataset(rows_frame(spark, [row], ["name", "id"]), {"path": f"{folder}/{i}", "format": "parquet"})
    for paths in ([f"{folder}/0", f"{folder}/2"], (pathlib.Path(folder) / "0", pathlib.Path(folder) / "2")):
        df = read_dataset(spark, {"path": paths, "format": "parquet"})
        assert sorted(r.id for r in df.collect()) == [1, 3]
    assert read_dataset(spark, {"path": pathlib.Path(folder) / "1", "format": "parquet"}).first().id == 2


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_schema_evolution(spark, folder, fmt):
    """Files of two generations read as one table, merged or as declared."""
    spec = {"path": folder, "format": fmt, "mode": "append"}
    write_dataset(rows_frame(spark, [(1, "a")], ["id", "old"]), spec)
    write_dataset(rows_frame(spark, [(2, "b")], ["id", "new"]), spec)
    expected = [(1, "a", None), (2, None, "b")]
    merged = read_dataset(spark, {**spec, "options": {"mergeSchema": "true"}})
    assert sorted(map(tuple, merged.select("id", "old", "new").collect())) == expected
    declared = read_dataset(spark, {**spec, "schema": "id BIGINT, old STRING, new STRING"})
    assert sorted(map(tuple, declared.collect())) == expected


@pytest.mark.parametrize("spec", [{}, {"format": "csv"}, {"path": "/x"}, {"path": "", "format": "csv"}])
def test_path_and_format_are_required(spark, spec):
    with pytest.raises(ValueError):
        read_dataset(spark, spec)
    with pytest.raises(ValueError):
        write_dataset(spark.range(1), spec)


def test_missing_path_raises(spark, folder):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_dataset(spark, {"path": folder, "format": "parquet"})


def test_unknown_format_raises(spark, folder):
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):
        read_dataset(spark, {"path": folder, "format": "nosuchformat"})


def test_rows_with_a_declared_schema(spark):
    df = rows_frame(spark, [("tuff", 1)], [{"name": "n", "type": "string"}, {"name": "i", "type": "int"}])
    assert df.dtypes == [("n", "string"), ("i", "int")]
    assert rows_frame(spark, [], "n STRING").count() == 0


def test_spec_defaults():
    spec = DatasetSpec.of({"path": "/x", "format": "csv"})
    assert (spec.mode, spec.save_mode, spec.partition_by, spec.options, spec.schema) == (None, "errorifexists", (), {}, None)
    assert DatasetSpec.of({"path": "/x", "format": "csv", "partition_by": "day"}).partition_by == ("day",)
    assert DatasetSpec.of(spec) is spec


def squares_source():
    """A format of the user's own: numbers and their squares.

    The classes are local so that they are shipped to the workers whole.
    """

    class Reader(DataSourceReader):
        def __init__(self, upto):
            self.upto = upto

        def partitions(self):
            return [InputPartition((i, self.upto)) for i in range(2)]

        def read(self, partition):
            start, upto = partition.value
            for n in range(start, upto, 2):
                yield n, n * n

    class Writer(DataSourceWriter):
        def __init__(self, path):
            self.path = path

        def write(self, rows):
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{uuid.uuid4().hex}.txt", "w") as out:
                out.writelines(f"{row.n}\n" for row in rows)
            return WriterCommitMessage()

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "n INT, square INT"

        def reader(self, schema):
            return Reader(int(self.options["upto"]))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return Squares


def test_a_format_of_ones_own(spark, folder):
    spark.dataSource.register(squares_source())
    df = read_dataset(spark, {"path": folder, "format": "squares", "options": {"upto": 5}})
    assert sorted(map(tuple, df.collect())) == [(0, 0), (1, 1), (2, 4), (3, 9), (4, 16)]
    write_dataset(df, {"path": folder, "format": "squares", "mode": "append"})
    lines = [line for name in glob.glob(f"{folder}/*.txt") for line in open(name)]
    assert sorted(map(int, lines)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("/data/in", "/data/in", True),
        ("/data/in/", "/data//in", True),
        ("/data/in", "/data/in/day=1", True),
        ("/data/in/*.csv", "/data/in", True),
        ("/data/*/x", "/data/a/x", True),
        ("/data/{a,b}/x", "/data/a/x", True),
        ("/data/in/../out", "/data/out", True),
        ("file:/data/in", "/data/in", True),
        ("file:///data/in", "file:/data/in", True),
        ("s3a://b/k", "s3://b/k", True),
        ("s3a://b/k", "s3a://c/k", False),
        ("hdfs://nn/data", "gs://nn/data", False),
        ("/data/in", "/data/inner", False),
        ("/data/*/x", "/data/a/y", False),
        ("in", "out", False),
        ("data/in", "hdfs://nn/user/me/data/in", True),
        ("data/in", "hdfs://nn/user/me/data/in/day=1", True),
        ("data/in", "hdfs://nn/user/me/data", True),
        ("data/in", "hdfs://nn/user/me/data/out", False),
        ("data/in", "data/in/day=1", True),
        ("hdfs://nn:8020/x", "hdfs://nn/x", True),
        ("hdfs://nn:8020/x", "hdfs://other/x", False),
        ("viewfs://c/x", "hdfs://nn/x", True),
        ("viewfs://c/x", "hdfs://nn/y", False),
        ("webhdfs://nn:9870/x", "hdfs://nn/x", True),
        ("abfs://c@a/x", "abfss://c@a/x", True),
        ("abfs://c@a/x", "abfss://d@a/x", False),
        ("wasb://c@a/x", "wasbs://c@a/x", True),
    ],
)
def test_overlap(a, b, expected):
    one, two = DatasetSpec("csv", a), DatasetSpec("csv", ["/elsewhere", b])
    assert overlap(one, two) is expected and overlap(two, one) is expected


def test_overlap_of_tables():
    def table(name):
        return DatasetSpec("jdbc", options={"url": "jdbc:x", "dbtable": name})

    assert overlap(table("t"), table("T"))
    assert not overlap(table("t"), table("u"))
    assert not overlap(table("t"), DatasetSpec("csv", "/t"))
