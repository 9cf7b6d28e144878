import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import types as T

from millrace import to_struct

EXPECTED = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("total", T.DecimalType(10, 2)),
        T.StructField("day", T.DateType()),
    ]
)


@pytest.mark.parametrize(
    "form",
    [
        "id INT, name STRING, total DECIMAL(10,2), day DATE",
        {"id": "integer", "name": "string", "total": "decimal(10,2)", "day": "date"},
        [
            {"name": "id", "type": "int"},
            {"name": "name", "type": "STRING", "nullable": True},
            {"name": "total", "type": "DECIMAL(10,2)"},
            {"name": "day", "type": "date"},
        ],
        EXPECTED,
        EXPECTED.jsonValue(),
    ],
    ids=["ddl", "map", "fields", "struct", "json"],
)
def test_all_forms_agree(spark, form):
    assert to_struct(form) == EXPECTED


@pytest.mark.parametrize("empty", [None, "", [], {}])
def test_falsy_means_no_schema(empty):
    assert to_struct(empty) is None


def test_nullable_is_kept(spark):
    struct = to_struct([{"name": "a", "type": "string", "nullable": False}, {"name": "b", "type": "double"}])
    assert [f.nullable for f in struct] == [False, True]
    assert [f.nullable for f in to_struct("a STRING NOT NULL, b DOUBLE")] == [False, True]


def test_nested_and_other_types(spark):
    struct = to_struct({"tags": "array<string>", "props": "map<string,double>", "ts": "timestamp_ntz"})
    assert struct["tags"].dataType == T.ArrayType(T.StringType())
    assert struct["props"].dataType == T.MapType(T.StringType(), T.DoubleType())
    assert struct["ts"].dataType == T.TimestampNTZType()


def test_columns_named_like_the_json_keys(spark):
    assert to_struct({"type": "string", "fields": "int"}).names == ["type", "fields"]


@pytest.mark.parametrize("bad", ["INT", [{"name": "a"}], [{"type": "int"}], {"a": 3}, ["a"]])
def test_unreadable_schema(spark, bad):
    with pytest.raises(ValueError):
        to_struct(bad)


def test_unknown_type(spark):
    with pytest.raises(Exception, match="nosuchtype"):
        to_struct({"a": "nosuchtype"})


def test_not_a_schema(spark):
    with pytest.raises(TypeError):
        to_struct(7)


NAMES = st.text(st.characters(categories=["L", "N"], include_characters=" ._-"), min_size=1, max_size=8)
KINDS = st.sampled_from(["int", "bigint", "string", "double", "date", "timestamp", "decimal(12,3)", "array<int>"])


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(fields=st.lists(st.tuples(NAMES, KINDS, st.booleans()), min_size=1, max_size=6))
def test_field_list_round_trip(spark, fields):
    struct = to_struct([{"name": n, "type": k, "nullable": b} for n, k, b in fields])
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in struct] == fields
    assert to_struct(struct.jsonValue()) == struct
