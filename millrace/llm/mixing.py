"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, gets a virtual finish time: the
words of its source up to and with it, divided by the source's target. One virtual
unit of time is then the whole mix; a source that repeats goes on counting in a
second and third round. All copies are ordered by finish time over all sources and
cut where the total budget is spent.

All of it is DataFrame functions. No running sum passes through one task: a
source is dealt into ``BUCKETS`` by the shuffle hash and the sums of buckets are
summed up; the cut is found in steps over fixed ranges of the finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.tables import word_count, written

# Hexadecimal digits of the shuffle hash that number a source's buckets: 4096 of them.
BUCKET_DIGITS = 3
# Ranges of virtual time: a unit has 2**22 fine ones, 2**14 of which make a coarse one.
FINE, PER_COARSE = float(1 << 22), 1 << 14
LAST_FINE = (1 << 32) - 1


def source_targets(sizes: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Words and target of every source.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last,
    take the ``weights`` in turn and share the words of all documents. No target is
    above ``max_repeats`` times its source; the excess goes to the others by weight.
    With ``r`` as the ratio of that limit to the weight, the sources of the lowest
    ratios are the limited ones, so one pass in the order of ``r`` finds the level
    at which all the others stand. Returns ``source``, ``source_size``, ``target``.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = (
        sums.withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * float(max_repeats))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    )
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum(
        "_weight"
    ).over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = rated.withColumn("_level", level)
    reached = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        F.least("_limit", F.coalesce(reached["_level"], F.lit(float("inf"))) * F.col("_weight")).alias("target"),
    )


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"):
    """``doc_id``, ``source``, ``size`` in words, and the keys of the shuffled order."""
    an_id, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        # Rows without an id, or of one, lie apart by their texts.
        F.md5(F.concat(F.lit("mix:"), an_id, F.lit(":"), text)).alias("_order"),
        text.alias("_text"),
    )


def schedule(sizes: DataFrame, targets: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Each copy that may be taken with its finish time.

    ``sizes`` as from ``document_sizes``; rows without words are left out. Adds
    ``source_size``, ``target``, ``copy`` from 0 and ``finish``. Whole rows that repeat
    follow each other; they are counted first, and are one row until the last step.
    """
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    rows = (
        sizes.filter("size > 0")
        .groupBy("source", "doc_id", "size", "_order", "_text")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_bucket", bucket)
        .withColumn("_all", F.col("size") * F.col("_rows"))
    )
    sums = rows.groupBy("source", "_bucket").agg(F.sum("_all").alias("_size"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_base_bucket"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"),
    )
    inside = (
        Window.partitionBy("source", "_bucket")
        .orderBy("_order", F.col("doc_id").asc_nulls_first(), "_text")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    own = rows.withColumn("_inside", F.sum("_all").over(inside) - F.col("_all"))
    placed = own.join(
        bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_base_bucket"))
    ).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    placed = placed.withColumn("_sum", F.col("_base") + F.col("_inside") + F.col("_row") * F.col("size"))
    named = targets.select(F.col("source").alias("_target_source"), "source_size", "target")
    copies = placed.join(named, F.col("source").eqNullSafe(F.col("_target_source"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    )
    finish = (F.col("copy") * F.col("source_size") + F.col("_sum")).cast("double") / F.col("target")
    return copies.select(
        "doc_id", "source", "size", "source_size", "target", "_order", "_text", "copy", finish.alias("finish")
    )


def within_budget(copies: DataFrame, budget: int) -> DataFrame:
    """The copies of the lowest finish times whose sizes add up to ``budget`` at most.

    The order is by finish time, source, copy, shuffle hash, id and text. The cut
    is narrowed down over sums by ranges of the finish time: 2**18 coarse ranges at
    most, then the 2**14 fine ones of the coarse range that holds the cut, then the
    copies of one fine range, which are a four-millionth of the mix.
    """
    fine = F.least(F.floor(F.col("finish") * FINE), F.lit(LAST_FINE)).cast("long")
    ranged = copies.withColumn("_fine", fine)
    sums = written(
        ranged.groupBy("_fine").agg(F.sum("size").alias("_size")).withColumn("_coarse", F.expr(f"_fine div {PER_COARSE}"))
    )
    cut, spent = _cut(sums.groupBy("_coarse").agg(F.sum("_size").alias("_size")), "_coarse", budget, 0)
    cut, spent = _cut(sums.filter(F.col("_coarse") == cut), "_fine", budget, spent)
    last = Window.orderBy(*queue_order()).rowsBetween(Window.unboundedPreceding, 0)
    whole = ranged.filter(F.col("_fine") < cut).drop("_fine")
    part = (
        ranged.filter(F.col("_fine") == cut)
        .withColumn("_sum", F.sum("size").over(last))
        .filter(F.col("_sum") <= budget - spent)
    )
    return whole.unionByName(part.drop("_fine", "_sum"))


def queue_order() -> list[Column]:
    return [
        F.col("finish"),
        F.col("source").asc_nulls_last(),
        F.col("copy"),
        F.col("_order"),
        F.col("doc_id").asc_nulls_first(),
        F.col("_text"),
    ]


def _cut(sums: DataFrame, key: str, budget: int, spent: int) -> tuple[int, int]:
    """The first range that goes over the budget, and what was spent before it."""
    upto = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    over = (
        sums.withColumn("_upto", F.sum("_size").over(upto) + F.lit(spent))
        .filter(F.col("_upto") > budget)
        .agg(F.min(F.struct(key, F.col("_upto") - F.col("_size"))).alias("first"))
        .first()["first"]
    )
    return (LAST_FINE + 1, spent) if over is None else (over[0], over[1])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs``: (sizes with targets of every document, the copies taken).

    The first has ``doc_id, source, size, source_size, target`` and the shuffle
    keys of every row, null and empty texts with size 0 included; the second the
    copies taken with ``copy`` and ``finish``. A null source is a source, last in
    order. A document goes in whole or not at all, ``max_repeats`` times at most;
    one without words is never taken. Empty tables give empty results. Other columns
    of ``docs`` are not looked at. Reruns agree: the order hangs on ids and texts
    alone.
    """
    sizes = written(document_sizes(docs, id_col, source_col, text_col))
    targets = written(source_targets(sizes, max_repeats, weights))
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    named = targets.select(F.col("source").alias("_target_source"), "source_size", "target")
    # A left join: it has a row for each document, whatever its source.
    every = sizes.join(named, F.col("source").eqNullSafe(F.col("_target_source")), "left").drop("_target_source")
    return every, within_budget(written(schedule(sizes, targets, max_repeats)), budget)


def taken_words(every: DataFrame, taken: DataFrame) -> DataFrame:
    """One row per document with ``taken``: the words that the mix takes, repeats counted.

    Whole rows that repeat share their copies: each is given the mean, rounded so
    that the sum holds.
    """
    keys = ["doc_id", "source", "_order", "_text"]
    counts = taken.groupBy(*keys).agg(F.sum("size").alias("_taken")).select(
        *[F.col(k).alias(f"_t{k}") for k in keys], "_taken"
    )
    same = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in ("size", "source_size", "target")])
    match = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in keys]
    joined = same.join(counts, match[0] & match[1] & match[2] & match[3], "left")
    copies = F.coalesce(F.expr("_taken div size"), F.lit(0)).cast("long")
    one = joined.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    share = F.expr("_n div _rows") + F.when(F.col("_row") <= F.col("_n") % F.col("_rows"), 1).otherwise(0)
    return one.withColumn("_n", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * share).cast("long").alias("taken")
    )
