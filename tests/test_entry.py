"""Every registered query against its SQL, on whole tables."""

import math
import os

import duckdb
import pytest
from places import TESTDATA

import __spark_entry__ as entry_module

SF_DIR = f"{TESTDATA}/{os.environ.get('TEST_SF', 'sf0.001')}"
TABLES = [name.removesuffix(".parquet") for name in sorted(os.listdir(SF_DIR))]

# DuckDB's names for the types the queries return.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "smallint": "SMALLINT",
    "decimal(14,3)": "DECIMAL(14,3)",
    "decimal(16,3)": "DECIMAL(16,3)",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert entry_module.job_queries().keys() == entry_module.job_oracle_sql().keys()


@pytest.mark.parametrize("key", entry_module.job_queries())
def test_query_matches_sql(spark, duck, key):
    result = entry_module.job_queries()[key](spark, SF_DIR)
    expected = duck.sql(entry_module.job_oracle_sql()[key])
    assert result.columns == expected.columns
    assert [TYPES[t] for _, t in result.dtypes] == [str(t) for t in expected.types]
    rows = sorted((tuple(map(_key, row)) for row in result.collect()))
    assert rows == sorted(tuple(map(_key, row)) for row in expected.fetchall())
    assert rows


@pytest.mark.parametrize("key", entry_module.job_queries())
def test_plan_stays_in_the_jvm_without_cross_joins(spark, key):
    plan = _plan(entry_module.job_queries()[key](spark, SF_DIR))
    for word in ("Python", "Cartesian", "NestedLoop", "ExistingRDD"):
        assert word not in plan


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["id", "name", "value", "name_upper", "event_date"]
    assert result.count() == 1000


def test_tables_may_be_folders_of_files(spark, folder):
    """On a cluster a table is a folder with many files."""
    for name in ("events", "lineitem"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(5).write.parquet(f"{folder}/{name}.parquet")
    queries = entry_module.job_queries()
    for key in ("stream_file_to_parquet", "job_csv_to_parquet", "sink_partitioned", "sort_rows"):
        split, whole = queries[key](spark, folder), queries[key](spark, SF_DIR)
        assert split.schema == whole.schema
        assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()


def test_pushed_filters_and_pruned_partitions(spark):
    queries = entry_module.job_queries()
    assert "GreaterThanOrEqual(l_discount,0.05)" in _plan(queries["filter_threshold"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts,2024-01-15T00:00)" in _plan(queries["filter_processing_date"](spark, SF_DIR))
    assert "PartitionFilters: [isnotnull(l_returnflag" in _plan(queries["scan_partition_pruned"](spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in _plan(
        queries["required_field_violations"](spark, SF_DIR)
    )
    assert "ReadSchema: struct<>" in _plan(queries["count_rows"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in _plan(queries["preview_top5"](spark, SF_DIR))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return (value is None, str(type(value)), value) if value is not None else (True, "", "")
