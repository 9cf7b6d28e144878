"""Intermediate tables and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sinks.scratch import scratch_dir

# White space of the word contracts: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and scan it again.

    Cuts the lineage: whatever executor is lost later, the rows are read again
    from storage and never computed a second, possibly different, time. So the
    shuffle files of the write are not needed any more, and Spark is asked to drop
    them at its end rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_dir(spark), spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of ``df`` has."""
    taken, found = {column.lower() for column in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def word_count(text: str | Column) -> Column:
    """Number of words in a text, 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
