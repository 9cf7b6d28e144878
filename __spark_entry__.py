"""

``queries()`` holds one entry per operator of the survey. Each reads the whole
of its tables; the ones about a sink or a text format first write the table with
``write_dataset`` to a scratch folder and return the DataFrame that reads it
back. ``oracle_sql()`` says the same in SQL, column for column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from millrace import (
    DatasetCatalog,
    count_rows,
    filter_processing_date,
    filter_threshold,
    preview,
    read_checked,
    read_dataset,
    read_generations,
    required_field_violations,
    rows_frame,
    run_job,
    run_stream_job,
    scratch_dir,
    sort_rows,
    upper_column,
    write_dataset,
)

# Declared schemas of the given tables, in the different forms a spec may use.
ORDERS_DDL = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)
EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
PART_DDL = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
CUSTOMER_STRUCT = StructType(
    [
        StructField("c_custkey", LongType()),
        StructField("c_name", StringType()),
        StructField("c_nationkey", IntegerType()),
        StructField("c_acctbal", DoubleType()),
        StructField("c_mktsegment", StringType()),
    ]
)
CUSTOMER_TYPES = {
    "c_custkey": "long",
    "c_name": "string",
    "c_nationkey": "integer",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}
PART_FIELDS = [
    {"name": "p_partkey", "type": "bigint", "nullable": False},
    {"name": "p_name", "type": "string", "nullable": True},
    {"name": "p_brand", "type": "string", "nullable": True},
    {"name": "p_type", "type": "string", "nullable": True},
    {"name": "p_size", "type": "int", "nullable": True},
    {"name": "p_retailprice", "type": "double", "nullable": True},
]
STOCK_FIELDS = [
    {"name": "p_brand", "type": "string", "nullable": True},
    {"name": "p_partkey", "type": "long", "nullable": False},
    {"name": "p_size", "type": "smallint", "nullable": True},
    {"name": "p_retailprice", "type": "double", "nullable": True},
]
LINEITEM_REQUIRED = [
    {"name": "l_orderkey", "type": "bigint", "nullable": False},
    {"name": "l_linenumber", "type": "int", "nullable": False},
    {"name": "l_returnflag", "type": "string", "nullable": False},
    {"name": "l_tax", "type": "double", "nullable": True},
]
# The id is a long: an int would turn to null in CSV past 2^31 events.
JOB_TYPES = {"id": "long", "name": "string", "value": "double", "event_date": "date"}

# The sample job's in-code rows.
SAMPLE_ROWS = [
    (1, "ProductA", 10.5, "2023-01-15"),
    (2, "ProductB", 20.0, "2023-01-16"),
    (3, "ProductC", 5.75, "2023-01-17"),
]

RUN_DATE = dt.date(2024, 1, 15)
# A malformed line fails the query instead of turning into nulls; null, empty and padded
# text and quotes come back as they were, and files can be read in pieces.
CSV_OPTIONS = {
    "header": "true",
    "mode": "FAILFAST",
    "nullValue": "\\N",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dataset(spark, {"path": f"{sf_dir}/{name}.parquet", "format": "parquet"})


def _through(df: DataFrame, fmt: str, read: dict[str, Any] | None = None, **write: Any) -> DataFrame:
    """Write ``df`` to a new folder and scan it again."""
    target = {"path": scratch_dir(df.sparkSession), "format": fmt, "mode": "overwrite", **write}
    write_dataset(df, target)
    return read_dataset(df.sparkSession, {"path": target["path"], "format": fmt, **(read or {})})


def _job_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        "value",
        F.to_date("ts").alias("event_date"),
    )


# --- jobs ---------------------------------------------------------------------


def job_csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    source = {"path": f"{base}/in", "format": "csv", "options": CSV_OPTIONS}
    destination = {"path": f"{base}/out", "format": "parquet", "partition_by": ["event_date"], "mode": "overwrite"}
    write_dataset(_job_input(spark, sf_dir), {**source, "mode": "overwrite"})
    job = {
        "job_name": "csv_to_parquet",
        "source_data": {**source, "schema_definition": JOB_TYPES},
        "destination_data": destination,
    }
    if not run_job(spark, job):
        raise RuntimeError("the job failed, see the log")
    return read_dataset(spark, destination)


def job_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over named datasets, filtered by its parameters, one of them set for this run."""
    catalog = DatasetCatalog(
        spark,
        {
            "events_raw_v1": {"path": f"{sf_dir}/events.parquet", "format": "parquet", "schema": EVENTS_DDL},
            "events_daily_v1": {"path": scratch_dir(spark), "format": "parquet"},
        },
    )
    job = {
        "job_name": "with_parameters",
        "source_data": {"dataset_id": "events_raw_v1"},
        "destination_data": {"dataset_id": "events_daily_v1", "mode": "overwrite"},
        "parameters": {
            "processing_date": "today",
            "date_column": "ts",
            "filter_threshold": 0.5,
            "threshold_column": "value",
        },
    }
    if not run_job(spark, job, [upper_column("event_type")], {"processing_date": RUN_DATE}, catalog):
        raise RuntimeError("the job failed, see the log")
    return catalog.table("events_daily_v1")


def stream_file_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    job = {
        "job_name": "stream_file_to_parquet",
        "source_data": {
            # A glob, because a file stream takes a plain path for a folder and this may be one file.
            "path": f"{sf_dir}/{{events}}.parquet",
            "format": "parquet",
            "schema": EVENTS_DDL,
            "options": {"maxFilesPerTrigger": "1000"},
        },
        "destination_data": {
            "path": f"{base}/out",
            "format": "parquet",
            "mode": "append",
            "options": {"checkpointLocation": f"{base}/checkpoint"},
        },
    }
    if not run_stream_job(spark, job, [upper_column("event_type")]):
        raise RuntimeError("the stream failed, see the log")
    return read_dataset(spark, {"path": f"{base}/out", "format": "parquet"})


# --- scans --------------------------------------------------------------------


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part")


def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": {**CSV_OPTIONS, "inferSchema": "true"}}
    return _through(_table(spark, sf_dir, "customer"), "csv", read, options=CSV_OPTIONS)


def scan_csv_ddl_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": CSV_OPTIONS, "schema": ORDERS_DDL}
    return _through(_table(spark, sf_dir, "orders"), "csv", read, options=CSV_OPTIONS)


def scan_csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day to the microsecond and quoted text, through CSV."""
    read = {"options": CSV_OPTIONS, "schema": EVENTS_DDL}
    return _through(_table(spark, sf_dir, "events"), "csv", read, options=CSV_OPTIONS)


def scan_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": {"mode": "FAILFAST"}, "schema": EVENTS_DDL}
    return _through(_table(spark, sf_dir, "events"), "json", read)


def scan_csv_struct_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": CSV_OPTIONS, "schema": CUSTOMER_STRUCT}
    return _through(_table(spark, sf_dir, "customer"), "csv", read, options=CSV_OPTIONS)


def scan_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {**CSV_OPTIONS, "header": "false", "sep": "|"}
    return _through(_table(spark, sf_dir, "part"), "csv", {"options": options, "schema": PART_DDL}, options=options)


def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": {"mode": "FAILFAST"}, "schema": CUSTOMER_STRUCT}
    return _through(_table(spark, sf_dir, "customer"), "json", read)


def scan_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(_table(spark, sf_dir, "supplier"), "orc")


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The in-code rows, appended to the events."""
    target = {"path": scratch_dir(spark), "format": "parquet", "mode": "append"}
    write_dataset(_job_input(spark, sf_dir).withColumn("event_date", F.col("event_date").cast("string")), target)
    write_dataset(rows_frame(spark, SAMPLE_ROWS, ["id", "name", "value", "event_date"]), target)
    return read_dataset(spark, {**target, "schema": {**JOB_TYPES, "event_date": "string"}})


# --- sinks --------------------------------------------------------------------


def _two_writes(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Customers of the nations below ten, then all others into the same place."""
    customer, target = _table(spark, sf_dir, "customer"), {"path": scratch_dir(spark) + "/out", "format": "parquet"}
    write_dataset(customer.filter("c_nationkey < 10"), target)
    write_dataset(customer.filter("NOT coalesce(c_nationkey < 10, false)"), {**target, "mode": mode})
    return read_dataset(spark, target)


def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(_table(spark, sf_dir, "lineitem"), "parquet")


def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_writes(spark, sf_dir, "overwrite")


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_writes(spark, sf_dir, "append")


def sink_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_writes(spark, sf_dir, "ignore")


def sink_errorifexists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, target = _table(spark, sf_dir, "customer"), {"path": scratch_dir(spark) + "/out", "format": "parquet"}
    write_dataset(customer.filter("c_nationkey < 10"), target)
    try:
        write_dataset(customer.filter("NOT coalesce(c_nationkey < 10, false)"), target)
    except AnalysisException:
        return read_dataset(spark, target)
    raise RuntimeError("the second write should have failed")


def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three values with very many rows each: a shuffle would not save files."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return _through(lineitem, "parquet", partition_by="l_returnflag", rebalance=False)


def scan_partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink_partitioned(spark, sf_dir).filter(F.col("l_returnflag") == "R")


def sink_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(_table(spark, sf_dir, "orders"), "parquet", options={"compression": "gzip"})


# --- projections and filters --------------------------------------------------


def project_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").transform(upper_column("p_name"))


def project_upper_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").transform(upper_column("name"))


def filter_threshold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").transform(filter_threshold("l_discount", 0.05))


def filter_processing_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").transform(filter_processing_date("ts", RUN_DATE))


# --- counting, ordering, looking ----------------------------------------------


def count_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(_table(spark, sf_dir, "lineitem"))


def sort_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_rows(_table(spark, sf_dir, "lineitem"), "l_returnflag")


def preview_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(_table(spark, sf_dir, "orders"), by="o_orderkey")


# --- catalog and declared schemas ---------------------------------------------


def scan_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset by a name that is no identifier, found as a view too."""
    catalog = DatasetCatalog(spark)
    catalog.register("crm.parts-v1", {"path": f"{sf_dir}/part.parquet", "format": "parquet", "schema": PART_FIELDS})
    catalog.table("crm.parts-v1")
    return spark.table("`crm.parts-v1`")


def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the entries of a catalog declare, beside the rows that a scan of each finds."""
    catalog = DatasetCatalog(
        spark,
        {
            "parts": {"path": f"{sf_dir}/part.parquet", "format": "parquet", "schema": PART_FIELDS},
            "customers": {"path": f"{sf_dir}/customer.parquet", "format": "parquet", "schema": CUSTOMER_TYPES},
        },
    )
    tables = []
    for dataset_id in catalog.ids():
        fields = [
            F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"))
            for f in catalog.schema(dataset_id)
        ]
        counted = count_rows(catalog.table(dataset_id), "n_rows")
        tables.append(counted.select(F.lit(dataset_id).alias("dataset_id"), F.explode(F.array(*fields)).alias("f"), "n_rows"))
    return tables[0].unionByName(tables[1]).select("dataset_id", "f.field", "f.type", "n_rows")


def schema_from_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    read = {"options": CSV_OPTIONS, "schema": STOCK_FIELDS}
    return _through(stock, "csv", read, options=CSV_OPTIONS)


def schema_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {"options": CSV_OPTIONS, "schema_definition": CUSTOMER_TYPES}
    return _through(_table(spark, sf_dir, "customer"), "csv", read, options=CSV_OPTIONS)


def schema_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(14,3)").alias("price")
    )
    return _through(prices, "orc", {"schema": "l_orderkey BIGINT, l_linenumber INT, price DECIMAL(14,3)"})


def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, target = _table(spark, sf_dir, "part"), {"path": scratch_dir(spark), "format": "parquet", "mode": "append"}
    write_dataset(part.select("p_partkey", "p_name"), target)
    write_dataset(part.select("p_partkey", "p_brand"), target)
    return read_dataset(spark, {**target, "options": {"mergeSchema": "true"}}).select(
        "p_partkey", "p_name", "p_brand"
    )


def required_field_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in the required fields of a table that has some: its first lines and returned items."""
    holed = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"),
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        "l_tax",
    )
    entry = {"path": scratch_dir(spark), "format": "parquet", "schema": LINEITEM_REQUIRED}
    write_dataset(holed, {**entry, "mode": "overwrite"})
    return DatasetCatalog(spark, {"holed_lines": entry}).violations("holed_lines")


# --- checks, versions, runs and generations -------------------------------------


def quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, some without required fields: good rows and rejects of one pass, with what that pass has counted."""
    base = scratch_dir(spark)
    source = {"path": f"{base}/in", "format": "parquet"}
    holed = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"),
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        "l_tax",
    )
    write_dataset(holed, {**source, "mode": "overwrite"})
    target = {"path": f"{base}/out", "format": "parquet", "schema": LINEITEM_REQUIRED, "violations": "reject"}
    figures: dict[str, Any] = {}
    if not run_job(spark, {"source_data": source, "destination_data": target}, [], figures=figures):
        raise RuntimeError("the job failed, see the log")
    counted = {
        "n_read": "rows_read",
        "n_rejected": "rejected",
        "null_linenumber": "nulls:l_linenumber",
        "null_returnflag": "nulls:l_returnflag",
    }
    return read_checked(spark, target).withColumns({name: F.lit(figures[key]).cast("long") for name, key in counted.items()})


def scan_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, every fiftieth cut off: rows and malformed records of one pass."""
    base = scratch_dir(spark)
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    line = F.to_json(F.struct("*"))
    broken = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(", cut")))
    write_dataset(events.select(F.coalesce(broken, line).alias("value")), {"path": f"{base}/in", "format": "text"})
    schema = "event_id BIGINT NOT NULL, user_id BIGINT, event_type STRING, value DOUBLE"
    job = {
        "source_data": {"path": f"{base}/in", "format": "json", "schema": schema, "malformed": True},
        "destination_data": {"path": f"{base}/out", "format": "parquet", "schema": schema, "violations": "reject"},
    }
    if not run_job(spark, job, []):
        raise RuntimeError("the job failed, see the log")
    return read_checked(spark, job["destination_data"]).select(
        "event_id", "user_id", "event_type", "value", "malformed_record", "row_status",
        F.split("rejected_for", ",")[0].alias("rejected_for"),
    )


def sink_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the customers, and a third that dies: readers have the second."""
    customer, target = _table(spark, sf_dir, "customer"), {"path": scratch_dir(spark), "format": "parquet", "versioned": True}
    write_dataset(customer.filter("c_nationkey < 10"), target)
    write_dataset(customer.filter("NOT coalesce(c_nationkey < 10, false)"), target)
    dies = customer.withColumn("c_name", F.when(F.col("c_custkey") >= 0, F.raise_error(F.lit("the third version"))))
    try:
        write_dataset(dies, target)
    except Exception:
        return read_dataset(spark, target)
    raise RuntimeError("the third version should have failed")


def sink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append customers, and the first is repeated."""
    customer, target = _table(spark, sf_dir, "customer"), {"path": scratch_dir(spark), "format": "parquet"}
    runs = {"low": "coalesce(c_nationkey < 10, false)", "high": "NOT coalesce(c_nationkey < 10, false)"}
    for run in ("low", "high", "low"):
        write_dataset(customer.filter(runs[run]), {**target, "run_id": run})
    return read_dataset(spark, target)


def sink_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items sorted by part within their files, and those of a few parts."""
    lineitem = _table(spark, sf_dir, "lineitem")
    result = _through(
        lineitem, "parquet", partition_by="l_returnflag", sort_by="l_partkey",
        options={"parquet.block.size": "1048576"},
    )
    return result.filter(F.col("l_partkey") <= 100)


def schema_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three generations: narrower and fewer columns, others in another order and format, and today's."""
    orders, base = _table(spark, sf_dir, "orders"), scratch_dir(spark)
    third = F.col("o_orderkey") % 3
    first = orders.filter(third == 0).select(
        "o_orderkey",
        F.col("o_totalprice").cast("float").alias("o_totalprice"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_paid"),
        F.year("o_orderdate").alias("o_year"),
    )
    second = orders.filter(third == 1).select(
        F.lit("old").alias("o_note"),
        "o_orderpriority",
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_paid"),
        "o_totalprice",
        "o_orderkey",
    )
    last = orders.filter(~third.isin(0, 1)).select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_totalprice").cast("decimal(16,3)").alias("o_paid"),
        F.year("o_orderdate").cast("long").alias("o_year"),
        "o_orderpriority",
    )
    csv = {
        "path": f"{base}/2", "format": "csv", "options": CSV_OPTIONS,
        "schema": "o_note STRING, o_orderpriority STRING, o_paid DECIMAL(12,2), o_totalprice DOUBLE, o_orderkey BIGINT",
    }
    generations = [{"path": f"{base}/1", "format": "parquet"}, csv, {"path": f"{base}/3", "format": "orc"}]
    for rows, generation in zip((first, second, last), generations):
        write_dataset(rows, generation)
    return read_generations(
        spark,
        generations,
        "o_orderkey BIGINT NOT NULL, o_totalprice DOUBLE, o_paid DECIMAL(16,3), o_year BIGINT, o_orderpriority STRING",
    )


def job_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days of events in one plan, replaced in a table that has all days."""
    base = scratch_dir(spark)
    source = {"path": f"{base}/in", "format": "parquet", "partition_by": "event_date", "rebalance": 1}
    target = {
        "path": f"{base}/out", "format": "parquet", "partition_by": "event_date", "rebalance": 1, "mode": "overwrite",
        "options": {"partitionOverwriteMode": "dynamic"},
    }
    write_dataset(_job_input(spark, sf_dir), source)
    write_dataset(read_dataset(spark, source).withColumn("name_upper", F.lit("old")), target)
    job = {
        "source_data": source,
        "destination_data": target,
        "parameters": {"date_column": "event_date", "processing_date": {"from": "2024-01-10", "to": "2024-01-16"}},
    }
    if not run_job(spark, job):
        raise RuntimeError("the job failed, see the log")
    return read_dataset(spark, target)


def job_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job has read and written, counted by the write itself, beside the rows that are there."""
    base = scratch_dir(spark)
    job = {
        "source_data": {"path": f"{sf_dir}/lineitem.parquet", "format": "parquet"},
        "destination_data": {"path": f"{base}/out", "format": "parquet"},
        "parameters": {"filter_threshold": 0.05, "threshold_column": "l_discount"},
    }
    figures: dict[str, Any] = {}
    if not run_job(spark, job, [upper_column("l_returnflag")], figures=figures):
        raise RuntimeError("the job failed, see the log")
    written = count_rows(read_dataset(spark, job["destination_data"]), "n")
    return written.select(
        F.lit(figures["rows_read"]).cast("long").alias("n_read"), F.lit(figures["rows"]).cast("long").alias("n_written"), "n"
    )


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream whose batches are runs; the stream is started twice."""
    base = scratch_dir(spark)
    write_dataset(_table(spark, sf_dir, "events").repartition(4), {"path": f"{base}/in", "format": "parquet"})
    job = {
        "source_data": {
            "path": f"{base}/in", "format": "parquet", "schema": EVENTS_DDL, "options": {"maxFilesPerTrigger": "2"},
        },
        "destination_data": {
            "path": f"{base}/out", "format": "parquet", "run_id": "events",
            "options": {"checkpointLocation": f"{base}/checkpoint"},
        },
    }
    for _ in range(2):
        if not run_stream_job(spark, job, [upper_column("event_type")]):
            raise RuntimeError("the stream failed, see the log")
    return read_dataset(spark, {"path": f"{base}/out", "format": "parquet"}).drop("run_id")


try:
    import corpus_pipeline
    from millrace.llm import queries as _llm
except ImportError:  # the optional part is not there
    corpus_pipeline = _llm = None


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: a CSV source through the job into partitioned parquet."""
    return job_csv_to_parquet(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    if _llm is None:
        return job_queries()
    return {**job_queries(), **_llm.queries(), "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The same results in SQL over the given tables, where SQL can say them."""
    if _llm is None:
        return job_oracle_sql()
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**job_oracle_sql(), **_llm.oracle_sql(), **pipeline}


def job_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the job library itself."""
    return {
        "job_csv_to_parquet": job_csv_to_parquet,
        "job_with_parameters": job_with_parameters,
        "scan_parquet": scan_parquet,
        "scan_csv_inferred": scan_csv_inferred,
        "scan_csv_ddl_schema": scan_csv_ddl_schema,
        "scan_csv_struct_schema": scan_csv_struct_schema,
        "scan_csv_options": scan_csv_options,
        "scan_csv_events": scan_csv_events,
        "scan_json": scan_json,
        "scan_json_events": scan_json_events,
        "scan_orc": scan_orc,
        "local_rows": local_rows,
        "sink_parquet": sink_parquet,
        "sink_overwrite": sink_overwrite,
        "sink_append": sink_append,
        "sink_ignore": sink_ignore,
        "sink_errorifexists": sink_errorifexists,
        "sink_partitioned": sink_partitioned,
        "scan_partition_pruned": scan_partition_pruned,
        "sink_compressed": sink_compressed,
        "project_upper": project_upper,
        "project_upper_missing": project_upper_missing,
        "filter_threshold": filter_threshold_query,
        "filter_processing_date": filter_processing_date_query,
        "count_rows": count_rows_query,
        "sort_rows": sort_rows_query,
        "preview_top5": preview_top5,
        "scan_registered": scan_registered,
        "catalog_fields": catalog_fields,
        "schema_from_fields": schema_from_fields,
        "schema_from_map": schema_from_map,
        "schema_decimal": schema_decimal,
        "schema_merge": schema_merge,
        "required_field_violations": required_field_violations_query,
        "stream_file_to_parquet": stream_file_to_parquet,
        "quality_split": quality_split,
        "scan_malformed": scan_malformed,
        "sink_versioned": sink_versioned,
        "sink_runs": sink_runs,
        "sink_clustered": sink_clustered,
        "schema_generations": schema_generations,
        "job_backfill": job_backfill,
        "job_figures": job_figures,
        "stream_batches": stream_batches,
    }


def _catalog_fields_sql() -> str:
    parts = [("parts", field["name"], field["type"], "part") for field in PART_FIELDS]
    kinds = {"long": "bigint", "integer": "int"}
    customers = [("customers", name, kinds.get(kind, kind), "customer") for name, kind in CUSTOMER_TYPES.items()]
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset_id, '{name}' AS field, '{kind}' AS type, (SELECT count(*) FROM {source}) AS n_rows"
        for dataset, name, kind, source in parts + customers
    )


def job_oracle_sql() -> dict[str, str]:
    """The SQL of ``job_queries``."""
    return {
        "job_csv_to_parquet": """
            SELECT event_id AS id, event_type AS name, value, upper(event_type) AS name_upper,
                   CAST(ts AS DATE) AS event_date
            FROM events""",
        "job_with_parameters": """
            SELECT *, upper(event_type) AS event_type_upper
            FROM events
            WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND value >= CAST(0.5 AS DOUBLE)""",
        "scan_parquet": "SELECT * FROM part",
        # CSV inference takes the narrowest type that holds all values.
        "scan_csv_inferred": """
            SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
            FROM customer""",
        "scan_csv_ddl_schema": "SELECT * FROM orders",
        "scan_csv_struct_schema": "SELECT * FROM customer",
        "scan_csv_options": "SELECT * FROM part",
        "scan_csv_events": "SELECT * FROM events",
        "scan_json": "SELECT * FROM customer",
        "scan_json_events": "SELECT * FROM events",
        "scan_orc": "SELECT * FROM supplier",
        "local_rows": """
            SELECT event_id AS id, event_type AS name, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
            FROM events
            UNION ALL
            SELECT CAST(id AS BIGINT), name, CAST(value AS DOUBLE), event_date
            FROM (VALUES """
        + ", ".join(map(str, SAMPLE_ROWS))
        + """) AS t(id, name, value, event_date)""",
        "sink_parquet": "SELECT * FROM lineitem",
        "sink_overwrite": "SELECT * FROM customer WHERE NOT coalesce(c_nationkey < 10, false)",
        "sink_append": "SELECT * FROM customer",
        "sink_ignore": "SELECT * FROM customer WHERE c_nationkey < 10",
        "sink_errorifexists": "SELECT * FROM customer WHERE c_nationkey < 10",
        "sink_partitioned": "SELECT * EXCLUDE (l_returnflag), l_returnflag FROM lineitem",
        "scan_partition_pruned": """
            SELECT * EXCLUDE (l_returnflag), l_returnflag FROM lineitem WHERE l_returnflag = 'R'""",
        "sink_compressed": "SELECT * FROM orders",
        "project_upper": "SELECT *, upper(p_name) AS p_name_upper FROM part",
        "project_upper_missing": "SELECT * FROM orders",
        "filter_threshold": "SELECT * FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE)",
        "filter_processing_date": "SELECT * FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
        "count_rows": "SELECT count(*) AS n FROM lineitem",
        "sort_rows": "SELECT * FROM lineitem ORDER BY l_returnflag",
        "preview_top5": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
        "scan_registered": "SELECT * FROM part",
        "catalog_fields": _catalog_fields_sql(),
        "schema_from_fields": "SELECT p_brand, p_partkey, CAST(p_size AS SMALLINT) AS p_size, p_retailprice FROM part",
        "schema_from_map": "SELECT * FROM customer",
        "schema_decimal": """
            SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(14,3)) AS price FROM lineitem""",
        "schema_merge": """
            SELECT p_partkey, p_name, NULL::VARCHAR AS p_brand FROM part
            UNION ALL
            SELECT p_partkey, NULL, p_brand FROM part""",
        "required_field_violations": """
            SELECT count(*) FILTER (l_orderkey IS NULL) AS l_orderkey,
                   count(*) FILTER (nullif(l_linenumber, 1) IS NULL) AS l_linenumber,
                   count(*) FILTER (nullif(l_returnflag, 'R') IS NULL) AS l_returnflag
            FROM lineitem""",
        "stream_file_to_parquet": "SELECT *, upper(event_type) AS event_type_upper FROM events",
        "quality_split": """
            WITH holed AS (
                SELECT l_orderkey, nullif(l_linenumber, 1) AS l_linenumber, nullif(l_returnflag, 'R') AS l_returnflag, l_tax
                FROM lineitem),
            marked AS (
                SELECT *, nullif(concat_ws(',', CASE WHEN l_orderkey IS NULL THEN 'l_orderkey' END,
                                           CASE WHEN l_linenumber IS NULL THEN 'l_linenumber' END,
                                           CASE WHEN l_returnflag IS NULL THEN 'l_returnflag' END), '') AS rejected_for
                FROM holed)
            SELECT *, CASE WHEN rejected_for IS NULL THEN 'accepted' ELSE 'rejected' END AS row_status,
                   count(*) OVER () AS n_read, count(rejected_for) OVER () AS n_rejected,
                   count(*) FILTER (l_linenumber IS NULL) OVER () AS null_linenumber,
                   count(*) FILTER (l_returnflag IS NULL) OVER () AS null_returnflag
            FROM marked""",
        "scan_malformed": """
            SELECT event_id, user_id, event_type, value, NULL::VARCHAR AS malformed_record,
                   'accepted' AS row_status, NULL::VARCHAR AS rejected_for
            FROM events WHERE event_id % 50 <> 0
            UNION ALL
            SELECT NULL, NULL, NULL, NULL, '{"event_id": ' || event_id || ', cut', 'rejected', 'malformed'
            FROM events WHERE event_id % 50 = 0""",
        "sink_versioned": "SELECT * FROM customer WHERE NOT coalesce(c_nationkey < 10, false)",
        "sink_runs": "SELECT *, CASE WHEN c_nationkey < 10 THEN 'low' ELSE 'high' END AS run_id FROM customer",
        "sink_clustered": "SELECT * EXCLUDE (l_returnflag), l_returnflag FROM lineitem WHERE l_partkey <= 100",
        "schema_generations": """
            SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS o_totalprice,
                   CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(16,3)) AS o_paid,
                   CAST(year(o_orderdate) AS BIGINT) AS o_year, NULL::VARCHAR AS o_orderpriority
            FROM orders WHERE o_orderkey % 3 = 0
            UNION ALL
            SELECT o_orderkey, o_totalprice, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(16,3)), NULL, o_orderpriority
            FROM orders WHERE o_orderkey % 3 = 1
            UNION ALL
            SELECT o_orderkey, o_totalprice, CAST(o_totalprice AS DECIMAL(16,3)), year(o_orderdate), o_orderpriority
            FROM orders WHERE o_orderkey % 3 NOT IN (0, 1)""",
        "job_backfill": """
            SELECT event_id AS id, event_type AS name, value,
                   CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'
                        THEN upper(event_type) ELSE 'old' END AS name_upper,
                   CAST(ts AS DATE) AS event_date
            FROM events""",
        "job_figures": """
            SELECT (SELECT count(*) FROM lineitem) AS n_read, count(*) AS n_written, count(*) AS n
            FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE)""",
        "stream_batches": "SELECT *, upper(event_type) AS event_type_upper FROM events",
    }
