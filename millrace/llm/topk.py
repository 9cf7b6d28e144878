"""Exact top-k by columnar branch and bound.

Vectors are turned into integers and scored by inner product. A block of candidates
lies in vertical layout: one array per dimension, the dimensions in order of their
mass. A query adds up its partial scores over one block of dimensions after the other.
After each, the Cauchy-Schwarz bound on what the remaining dimensions can add, the
query's remaining mass times the candidate's, tells which candidates can still reach
the query's k-th best score; the others are dropped and the arrays compacted.

Queries meet candidates in tiles, blocks of queries against groups of candidates, each
in a task that hands on ``k`` rows per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.tables import written
from millrace.llm.vectors import as_double, finite

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
DIMENSION_BLOCK = 16
# Integers below this have products whose sum over 2**20 dimensions is a decimal of 38 digits.
LARGEST = 1 << 52


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Each component x becomes floor(scale * x);
    the score is the exact integer inner product. A query's own row is no candidate.
    Null vectors and ones with null or non-finite components take no part, nor do rows
    without an id; only vectors of one length are compared. Rows that repeat an id are
    candidates of their own for others; as a query they are one, with the best scores of
    any of them, and none of them is its own candidate. Scores are decimals of 38 digits,
    exact also where they leave 64 bits; a component whose integer is not below 2**52 raises.
    Other columns are not looked at; an empty table gives an empty result.
    """
    whole = as_double(df, id_col, vector_col).filter(F.col("vec_id").isNotNull() & finite("v"))
    large = F.exists("v", lambda x: F.abs(x * scale) >= F.lit(float(LARGEST)))
    values = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(values)
    rows = written(whole.select("vec_id", checked.alias("q"), F.size("v").alias("d")))
    dimensions = rows.filter(F.col("d") > 0)
    candidates = dimensions.select("vec_id", "q", "d", F.xxhash64("vec_id", "q").alias("_hash"))
    n_candidates, n_queries = rows.count(), rows.filter(is_query).count()
    groups, blocks = max(1, -(-n_candidates // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    asked = candidates.filter(is_query).select(
        "d",
        F.pmod("_hash", F.lit(blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cg"),
        F.lit(0).alias("kind"),
        "vec_id",
        "q",
    )
    offered = candidates.select(
        "d",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"),
        F.pmod(F.xxhash64("_hash"), F.lit(groups)).alias("cg"),
        F.lit(1).alias("kind"),
        "vec_id",
        "q",
    )

    def tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack([np.asarray(v, dtype=np.int64) for v in frame["q"]])
        ask = (frame["kind"] == 0).to_numpy()
        ids = frame["vec_id"].to_numpy()
        best = _tile(ids[ask], matrix[ask], ids[~ask], matrix[~ask], k)
        return best.assign(score=pd.Series(list(map(str, best["score"].tolist())), dtype=object))

    found = asked.unionByName(offered).groupBy("d", "qb", "cg").applyInPandas(
        tile, "query_id long, vec_id long, score string"
    ).withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    out: list[pd.DataFrame] = []
    if len(ids) and len(query_ids):
        # Sums of products beyond 64 bits go through Python's integers.
        most = max(int(np.abs(matrix).max()), 1) * max(int(np.abs(queries).max()), 1)
        wide = most * matrix.shape[1] >= 1 << 62
        mass = (matrix.astype(np.float64) ** 2).sum(axis=0)
        order = np.argsort(-mass, kind="stable")
        columns = np.ascontiguousarray(matrix[:, order].T)
        starts = list(range(0, len(order), DIMENSION_BLOCK))
        squares = columns.astype(np.float64) ** 2
        if wide:
            columns, queries = columns.astype(object), queries.astype(object)
        # What is left of each candidate's mass from a block of dimensions on.
        rest = [np.sqrt(squares[s:].sum(axis=0)) for s in starts] + [np.zeros(len(ids))]
        seen: set[int] = set()
        for query_id, query in zip(query_ids.tolist(), queries[:, order]):
            if query_id in seen:
                continue
            seen.add(query_id)
            picked, scores = _branch_and_bound(query, query_id, ids, columns, starts, rest, k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[picked], "score": scores}))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.concat(out, ignore_index=True)


def _branch_and_bound(query, query_id, ids, columns, starts, rest, k):
    """Places and scores of the ``k`` best candidates of one query."""
    left = np.sqrt([float((query[s:].astype(np.float64) ** 2).sum()) for s in starts] + [0.0])
    alive = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(alive), dtype=columns.dtype)
    for step, start in enumerate(starts):
        block = columns[start : start + DIMENSION_BLOCK]
        part = block if len(alive) == len(ids) else block[:, alive]
        for weight, column in zip(query[start : start + DIMENSION_BLOCK].tolist(), part):
            if weight:
                partial = partial + weight * column
        if len(alive) <= k:
            continue
        reach = left[step + 1] * rest[step + 1][alive]
        about = partial.astype(np.float64)
        slack = 1e-9 * (np.abs(about) + reach) + 1.0
        # The k-th best of what each candidate is sure to reach.
        sure = about - reach - slack
        bar = np.partition(sure, len(sure) - k)[len(sure) - k]
        keep = about + reach + slack >= bar
        alive, partial = alive[keep], partial[keep]
    if partial.dtype == object:
        best = np.array(sorted(range(len(alive)), key=lambda i: (-partial[i], ids[alive[i]]))[:k], dtype=np.int64)
    else:
        best = np.lexsort((ids[alive], -partial))[:k]
    return alive[best], partial[best]
