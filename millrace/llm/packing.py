"""Packing documents into sequences by cutting-stock column generation.

A document of n ids is cut into full pieces of ``capacity`` ids and a rest. Full
pieces are sequences. The rests are the cutting-stock problem: their lengths,
rounded up to ``unit`` ids, form a histogram of ``capacity / unit`` classes, and a
linear program over patterns (how many rests of each class go into one sequence)
minimizes the sequences. Its columns are priced by a knapsack over the duals. The
solution is rounded down, what is left is packed best-fit, and the patterns are
handed to documents by their rank within a class.

Only the histogram, ``capacity / unit`` counts, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.tables import written
from millrace.llm.tokens import chunks_of_lengths, encoder, tokenizer_path

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _class int, _bucket int"
)
# A class is dealt into so many buckets to be ranked.
BUCKETS = 1024
# Characters encoded at once; more would meet more words again, but take a worker more memory.
CHUNK_CHARS = 3_000_000


def document_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, unit: int, id_col: str, text_col: str
) -> DataFrame:
    """Tokenize and cut: full pieces of ``capacity`` ids, then the rest."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_bucket"]
    types = [pa.int64()] * 5 + [pa.int32()] * 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, row = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for run in chunks_of_lengths(lengths, CHUNK_CHARS):
                out: list[tuple] = []
                # Only the texts of this run leave Arrow.
                own = [t or "" for t in texts.slice(run[0], len(run)).to_pylist()]
                for k, raw in zip(run, encode.encode(own)):
                    raw += end
                    n = len(raw) // 4
                    row += 1
                    for start in range(0, n, capacity):
                        piece = raw[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        out.append((ids[k], start, length, zlib.crc32(piece), n, -(-length // unit), row % BUCKETS))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(cut, PIECE_SCHEMA)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest value. ``values[l]`` is that of a class l item."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    gains = np.maximum(values[1 : capacity + 1], 0.0)
    for room in range(1, capacity + 1):
        totals = gains[:room] + best[room - 1 :: -1] if room > 1 else gains[:1] + best[:1]
        item = int(np.argmax(totals))
        best[room], choice[room] = totals[item], item + 1
    pattern = np.zeros(capacity + 1, dtype=np.int64)
    room = capacity
    while room > 0 and best[room] > 0:
        # An item without value only takes room; the pattern leaves that room free.
        pattern[choice[room]] += gains[choice[room] - 1] > 0
        room -= choice[room]
    return float(best[capacity]), pattern


def column_generation(counts: np.ndarray, capacity: int, max_columns: int = 2500) -> tuple[np.ndarray, np.ndarray]:
    """Solve the linear program: (patterns, how often each is used, not rounded).

    ``counts[l]`` items of size l. Revised simplex over equality rows: a basis has as
    many patterns as there are sizes. ``max_columns`` bounds the pivots; the basis
    at hand is feasible at any time.
    """
    sizes = np.flatnonzero(counts)
    demand = counts[sizes].astype(float)
    fill = (capacity // sizes).astype(np.int64)
    basis = np.diag(fill).astype(float)
    inverse, amount = np.diag(1.0 / fill), demand / fill
    values = np.zeros(capacity + 1)
    for step in range(max_columns):
        duals = inverse.sum(axis=0)
        values[:] = 0
        values[sizes] = duals
        worth, pattern = best_pattern(values, capacity)
        if worth <= 1 + 1e-9:
            break
        column = pattern[sizes].astype(float)
        direction = inverse @ column
        ratios = np.full(len(sizes), np.inf)
        positive = direction > 1e-9
        ratios[positive] = np.maximum(amount[positive], 0) / direction[positive]
        leaving = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = column
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaving] / direction[leaving]
            inverse -= np.outer(direction, row)
            inverse[leaving] = row
        amount = inverse @ demand
    patterns = np.zeros((len(sizes), capacity + 1), dtype=np.int64)
    patterns[:, sizes] = basis.T.round().astype(np.int64)
    return patterns, np.maximum(amount, 0)


def best_fit(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold exactly ``counts``, largest item first into the fullest sequence it fits."""
    room_of: dict[int, list[np.ndarray]] = {}
    for size in range(capacity, 0, -1):
        for _ in range(int(counts[size])):
            room = next((r for r in range(size, capacity + 1) if room_of.get(r)), None)
            pattern = room_of[room].pop() if room is not None else np.zeros(capacity + 1, dtype=np.int64)
            pattern[size] += 1
            room_of.setdefault((room if room is not None else capacity) - size, []).append(pattern)
    return [pattern for group in room_of.values() for pattern in group]


def cutting_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Whole patterns for all items: rows (class, first rank, end rank, per sequence, first sequence)."""
    left = counts.astype(np.int64).copy()
    used: list[tuple[np.ndarray, int]] = []
    if left.sum():
        patterns, amounts = column_generation(left, capacity)
        for pattern, amount in zip(patterns, amounts):
            times = int(np.floor(amount + 1e-9))
            held = pattern > 0
            if times > 0 and held.any():
                times = min(times, int((left[held] // pattern[held]).min()))
                if times > 0:
                    left -= times * pattern
                    used.append((pattern, times))
        used += [(pattern, 1) for pattern in best_fit(left, capacity)]
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for pattern, times in used:
        for size in np.flatnonzero(pattern):
            per = int(pattern[size])
            rows.append((int(size), int(rank[size]), int(rank[size]) + per * times, per, sequence))
            rank[size] += per * times
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = 2048,
    unit: int = 16,
) -> DataFrame:
    """Where each piece of each document goes.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A null text is an empty one and has the end id alone. Rows that repeat, and rows
    without an id, are documents of their own. Very long texts are cut like others;
    an empty table gives an empty result. Other columns are not looked at.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    classes = capacity // unit
    pieces = written(
        document_pieces(docs, tokenizer or tokenizer_path(), end_id, capacity, unit, id_col, text_col)
    )
    sums = pieces.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(classes + 1, dtype=np.int64)
        for batch in batches:
            counts[batch["_class"].to_numpy()] = batch["_n"].to_numpy()
        names = ["_plan_class", "_lo", "_hi", "_per", "_sequence"]
        yield pd.DataFrame(cutting_plan(counts, classes), columns=names).astype("int64")

    # One row per class meets in one task: the histogram does not grow with the corpus.
    histogram = sums.groupBy("_class").agg(F.sum("_n").alias("_n")).repartition(1)
    plan = written(
        histogram.mapInPandas(solve, "_plan_class long, _lo long, _hi long, _per long, _sequence long")
    )
    earlier = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("_class").alias("_base_class"),
        F.col("_bucket").alias("_base_bucket"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy("_class", "_bucket").orderBy(
        F.col("doc_id").asc_nulls_first(), "start", "length", "ids_crc32", "doc_tokens"
    )
    ranked = (
        pieces.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(bases, (F.col("_class") == F.col("_base_class")) & (F.col("_bucket") == F.col("_base_bucket")))
        .withColumn("_rank", F.col("_base") + F.col("_inside"))
    )
    # The plan has a few rows per class, whatever the size of the corpus.
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("_class") == F.col("_plan_class")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    ).withColumn("sequence_id", F.col("_sequence") + F.expr("(_rank - _lo) div _per"))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank")
    before = in_sequence.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def padded_length(used: int, capacity: int = 2048) -> int:
    """Ids that a sequence takes in a batch: a power of two stays as it is, all else is padded."""
    return used if used > 0 and used & (used - 1) == 0 else capacity


def packed_sequences(
    docs: DataFrame,
    layout: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids array<int>, doc_ids array<long>`` in order of offset.

    Joins ``layout``, the result of ``pack`` on the same documents, with the ids of
    each document, so documents need ids of their own here.
    """
    path = tokenizer or tokenizer_path()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            coded = [np.frombuffer(raw + end, dtype="<u4").astype(np.int32) for raw in encode.encode(texts)]
            yield pd.DataFrame({"_id": batch["_id"].astype("Int64"), "_ids": coded})

    coded = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).mapInPandas(
        tokenize, "_id long, _ids array<int>"
    )
    parts = layout.join(coded, F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "sequence_id",
        "offset",
        "doc_id",
        F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("_part"),
    )
    listed = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "_part", "doc_id"))).alias("_parts"))
    return listed.select(
        "sequence_id",
        F.flatten(F.transform("_parts", lambda p: p["_part"])).alias("ids"),
        F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )
