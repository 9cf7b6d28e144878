"""The corpus pipeline: documents through five operators, each stage a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import stages
from millrace.llm.tables import table, written

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_dedup", stages.simhash_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

# SQL has no string kernels, shingle hashes or linear programs; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
