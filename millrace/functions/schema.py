"""Declared schemas in any of their written forms, as one ``StructType``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql.types import DataType, StructField, StructType


def to_struct(schema: Any) -> StructType | None:
    """Return the ``StructType`` for a declared schema, or ``None`` for a falsy one.

    Accepted forms:

    * a ``StructType``, returned as it is;
    * a DDL string, ``"id INT, name STRING NOT NULL"``;
    * a field list, ``[{"name": "id", "type": "int", "nullable": False}, ...]``;
    * a name-to-type map, ``{"id": "integer", "name": "string"}``;
    * Spark's JSON form, ``{"type": "struct", "fields": [...]}``.

    Types inside field lists and maps are DDL types, so ``DECIMAL(10,2)``,
    ``timestamp_ntz`` or ``array<string>`` work as well as the plain ones.
    """
    if not schema:
        return None
    if isinstance(schema, StructType):
        return schema
    if isinstance(schema, str):
        return _struct_from_ddl(schema)
    if isinstance(schema, Mapping):
        if isinstance(schema.get("fields"), Sequence) and not isinstance(schema["fields"], str):
            return StructType.fromJson(dict(schema))
        return StructType([StructField(name, _type(kind)) for name, kind in schema.items()])
    if isinstance(schema, Sequence):
        return StructType([_field(entry) for entry in schema])
    raise TypeError(f"cannot read a schema from {type(schema).__name__}")


def _struct_from_ddl(ddl: str) -> StructType:
    parsed = DataType.fromDDL(ddl)
    # A bare type such as "INT" parses too, but names no column.
    if not isinstance(parsed, StructType):
        raise ValueError(f"schema DDL must name its columns: {ddl!r}")
    return parsed


def _field(entry: Any) -> StructField:
    if isinstance(entry, StructField):
        return entry
    if not isinstance(entry, Mapping) or not entry.get("name") or not entry.get("type"):
        raise ValueError(f"a schema field needs 'name' and 'type': {entry!r}")
    return StructField(entry["name"], _type(entry["type"]), bool(entry.get("nullable", True)))


def _type(kind: Any) -> DataType:
    if isinstance(kind, DataType):
        return kind
    if isinstance(kind, str):
        return DataType.fromDDL(kind)
    raise ValueError(f"a schema type must be a DDL type: {kind!r}")
