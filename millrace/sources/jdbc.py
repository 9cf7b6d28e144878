"""Database tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.columns import quoted
from millrace.sources.spec import DatasetSpec

_RANGE_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_jdbc(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Scan a database table in parallel.

    Spark reads an unpartitioned JDBC source through one task, so the spec has
    to say how to split the table: either the four range options
    (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``) or
    ``predicates``, one condition per partition. Range bounds only set the
    stride, rows outside of them still arrive. Split on a unique or evenly
    spread column; where a value is hot, give predicates that cut it further.
    For a table known to be small, ``numPartitions`` 1 asks for a single task.
    A declared schema sets the types of its columns.
    """
    url, table = _location(spec)
    options = {**spec.options, **_declared_types(spec)}
    if spec.predicates:
        properties = {k: str(v) for k, v in options.items() if k.lower() not in ("url", "dbtable")}
        return spark.read.jdbc(url, table, predicates=list(spec.predicates), properties=properties)
    missing = [name for name in _RANGE_OPTIONS if spec.option(name) is None]
    if missing and str(spec.option("numPartitions")) != "1":
        raise ValueError(
            f"a jdbc scan needs 'predicates' or {', '.join(_RANGE_OPTIONS)}; missing: {', '.join(missing)}"
        )
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, spec: DatasetSpec) -> None:
    """Write to a database table, one transaction and connection per partition.

    ``numPartitions`` has to be given: it bounds the connections, which would
    otherwise be as many as the frame has tasks. A task that is
    repeated after its commit inserts its rows again, so give the target table a
    primary key: the repeat then fails instead of duplicating rows.
    """
    _location(spec)
    if spec.option("numPartitions") is None:
        raise ValueError("a jdbc write needs 'numPartitions', the number of connections")
    df.write.format("jdbc").mode(spec.save_mode).options(**spec.options).save()


def _declared_types(spec: DatasetSpec) -> dict[str, str]:
    if spec.schema is None:
        return {}
    if spec.option("customSchema") is not None:
        raise ValueError("a jdbc dataset takes a declared schema or 'customSchema', not both")
    fields = (f"{quoted(field.name)} {field.dataType.simpleString()}" for field in spec.schema)
    return {"customSchema": ", ".join(fields)}


def _location(spec: DatasetSpec) -> tuple[str, str]:
    url, table = spec.option("url"), spec.option("dbtable")
    if not url or not table:
        raise ValueError("a jdbc dataset needs the options 'url' and 'dbtable'")
    return url, table
