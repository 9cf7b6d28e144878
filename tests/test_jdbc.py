"""The JDBC calls, recorded. No database is started for them."""

import pytest

from millrace import read_dataset, write_dataset

LOCATION = {"url": "jdbc:somedb://host/db", "dbtable": "supplier"}
RANGE = {"partitionColumn": "s_suppkey", "lowerBound": 1, "upperBound": 1000, "numPartitions": 8}


class Recorder:
    """Stands in for a session or a frame and notes each call."""

    def __init__(self):
        self.calls = {}

    read = write = property(lambda self: self)

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls[name] = (args, kwargs)
            return self

        return call


def test_range_scan():
    spark = Recorder()
    read_dataset(spark, {"format": "jdbc", "options": {**LOCATION, **RANGE}})
    assert spark.calls["format"] == (("jdbc",), {})
    assert spark.calls["options"] == ((), {**LOCATION, **RANGE})
    assert "load" in spark.calls


def test_option_names_in_any_case():
    spark = Recorder()
    options = {key.upper(): value for key, value in {**LOCATION, **RANGE}.items()}
    read_dataset(spark, {"format": "JDBC", "options": options})
    assert spark.calls["options"] == ((), options)


def test_predicate_scan():
    spark = Recorder()
    spec = {"format": "jdbc", "options": {**LOCATION, "fetchsize": 1000}, "predicates": ["k < 5", "k >= 5"]}
    read_dataset(spark, spec)
    assert spark.calls["jdbc"] == (
        ("jdbc:somedb://host/db", "supplier"),
        {"predicates": ["k < 5", "k >= 5"], "properties": {"fetchsize": "1000"}},
    )


def test_a_declared_schema_sets_the_types():
    schema = "s_suppkey DECIMAL(12,0), `odd name` STRING"
    declared = {"customSchema": "`s_suppkey` decimal(12,0), `odd name` string"}
    spark = Recorder()
    read_dataset(spark, {"format": "jdbc", "schema": schema, "options": {**LOCATION, **RANGE}})
    assert spark.calls["options"] == ((), {**LOCATION, **RANGE, **declared})
    read_dataset(spark, {"format": "jdbc", "schema": schema, "options": LOCATION, "predicates": ["k < 5"]})
    assert spark.calls["jdbc"][1]["properties"] == declared
    with pytest.raises(ValueError, match="not both"):
        read_dataset(spark, {"format": "jdbc", "schema": schema, "options": {**LOCATION, **RANGE, **declared}})


def test_a_write_bounds_its_connections():
    with pytest.raises(ValueError, match="numPartitions"):
        write_dataset(Recorder(), {"format": "jdbc", "mode": "append", "options": LOCATION})


def test_one_task_only_when_asked_for():
    with pytest.raises(ValueError, match="partitionColumn"):
        read_dataset(Recorder(), {"format": "jdbc", "options": LOCATION})
    with pytest.raises(ValueError, match="lowerBound"):
        read_dataset(Recorder(), {"format": "jdbc", "options": {**LOCATION, "partitionColumn": "k", "numPartitions": 4}})
    read_dataset(Recorder(), {"format": "jdbc", "options": {**LOCATION, "numPartitions": 1}})


def test_write():
    df = Recorder()
    write_dataset(df, {"format": "jdbc", "mode": "append", "options": {**LOCATION, "numPartitions": 8}})
    assert df.calls["mode"] == (("append",), {})
    assert df.calls["options"] == ((), {**LOCATION, "numPartitions": 8})
    assert "save" in df.calls


@pytest.mark.parametrize("missing", ["url", "dbtable"])
def test_location_is_required(missing):
    options = {k: v for k, v in {**LOCATION, **RANGE}.items() if k != missing}
    with pytest.raises(ValueError, match="'url' and 'dbtable'"):
        read_dataset(Recorder(), {"format": "jdbc", "options": options})
    with pytest.raises(ValueError, match="'url' and 'dbtable'"):
        write_dataset(Recorder(), {"format": "jdbc", "options": options})
