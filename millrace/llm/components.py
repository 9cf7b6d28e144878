"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.tables import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node it can reach.

    Alternates two steps: each node ties its larger neighbours to the smallest it
    knows, then each node ties its smaller neighbours and itself to the smallest of
    them. Every round is two aggregates of minima, summed up before the shuffle, and
    joins that adaptive execution may split; nothing is gathered by node. The rounds
    grow with the logarithm of the longest chain. Each is written, so a lost executor
    costs one round at most. Nulls and links to oneself are left out.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    edges, before = written(edges), None
    for _ in range(max_rounds):
        edges = written(_tie_smaller(_tie_larger(edges)))
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _tie_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_v")).select(
        F.col("u").alias("_u"), F.least("u", "_v").alias("_least")
    )
    # Only the larger neighbours are tied anew; from their side the row is the edge itself.
    return (
        edges.select(F.col("v").alias("_near"), F.col("u").alias("_far"))
        .join(least, F.col("_near") == F.col("_u"))
        .select(F.col("_far").alias("u"), F.col("_least").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _tie_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("_least")).select(F.col("u").alias("_u"), "_least")
    tied = edges.join(least, F.col("u") == F.col("_u")).filter(F.col("v") != F.col("_least"))
    return (
        tied.select(F.col("v").alias("u"), F.col("_least").alias("v"))
        .unionByName(least.select(F.col("_u").alias("u"), F.col("_least").alias("v")))
        .distinct()
    )
