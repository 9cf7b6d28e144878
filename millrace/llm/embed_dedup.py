"""Near-duplicate embeddings by an epsilon grid order join.

Two vectors have a cosine of ``threshold`` or more if and only if their unit vectors
lie within epsilon = sqrt(2 - 2 threshold). The unit vectors are turned onto their
principal axes and sorted by the epsilon grid cells of the leading ones. Intervals of
that order have bounding boxes; the join starts from the pair of the whole sequence
with itself and goes down level by level, each pair of intervals giving the pairs of
its parts, and drops a pair as soon as its boxes are more than epsilon apart. What is
left at the bottom are pairs of blocks, whose vectors are compared in a task, again
interval by interval.

A block is a file in the shared scratch folder. A task compares the blocks of a tile of
pairs and reads each of their files once, so a block lies on disk once, however many it
is compared with. Whether two vectors can be near is told first from their coordinates
on the leading axes and the lengths of the rest.

Equal vectors are one class from the start and counted. A tile of pairs gives back
the number of links of each class and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from millrace.llm.components import connected_components
from millrace.llm.tables import written
from millrace.sinks.scratch import scratch_dir

# Vectors in a block of the sequence (fewer if they are longer than ``WIDTH``), in a part compared at once inside a
# task, and parts of an interval. Blocks on each side of a tile, at most.
BLOCK, PART, FANOUT = 16384, 256, 8
WIDTH, TILE = 64, 8
GRID_AXES = 6
# Room for rounding when boxes are compared; it can only keep more pairs.
SLACK = 1e-6
# The share of pairs that the leading axes may leave.
LEFT = 1e-5
# Pairs of two parts that are looked at one by one, at most, and links that are held before they are counted.
FEW, MANY = 512, 1 << 20
_LAST = np.iinfo(np.int64).max


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link
    with nothing; vectors of different lengths do not link with each other. Rows that
    repeat are vectors of their own that link. Where ids repeat, each row counts; a
    row without an id takes part and is never the smallest. Other columns are not
    looked at; an empty table gives an empty result. The scratch folder lies on storage
    that Arrow's file systems know.
    """
    packed, kind = _packed(df, id_col, vector_col)
    rows = written(packed)
    good = rows.filter("digest IS NOT NULL")
    parts, counts, ties = [], [], []
    base = 0
    for length, n in sorted((r["d"], r["count"]) for r in good.groupBy("d").count().collect()):
        classes, found = _links(good.filter(F.col("d") == length), length, n, kind, threshold, base)
        base = (classes.agg(F.max("node")).first()[0] >> 33) + 1
        parts.append(classes)
        counts.append(found.filter("kind = 0").select("node", F.col("other").alias("_links")))
        ties.append(found.filter("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    lone = rows.filter("digest IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if not counts:
        return lone.withColumn("kept", F.lit(True))
    numbered, total, tie = parts[0], counts[0], ties[0]
    for part, more, other in zip(parts[1:], counts[1:], ties[1:]):
        numbered, total, tie = numbered.unionByName(part), total.unionByName(more), tie.unionByName(other)
    total = total.groupBy("node").agg(F.sum("_links").alias("_links"))
    roots = connected_components(tie).select(F.col("node").alias("_member"), "root")
    named = (
        numbered.join(total.withColumnRenamed("node", "_counted"), F.col("node") == F.col("_counted"), "left")
        .join(roots, F.col("node") == F.col("_member"), "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = written(named.select("digest", "_first", "_n", "root", F.coalesce("_links", F.lit(0)).alias("_links")))
    smallest = named.groupBy("root").agg(F.min("_first").alias("_component")).withColumnRenamed("root", "_root")
    of_class = named.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("digest").alias("_class"),
        (F.col("_links") + F.col("_n") - 1).cast("long").alias("n_links"),
        F.col("_component").alias("component_id"),
    )
    linked = good.join(of_class, F.col("digest") == F.col("_class"))
    every = linked.select("vec_id", "n_links", "component_id").unionByName(lone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _packed(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """``vec_id, d, vec, digest`` and the type of the numbers in ``vec``; no digest for a vector that can't be compared.

    The digest stands for the vector: 128 bits of BLAKE2b, the same for 0 and -0.
    """
    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    given = plain.schema["v"].dataType
    kind = "<f4" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "<f8"
    if kind == "<f8":
        plain = plain.withColumn("v", F.col("v").cast("array<double>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = pc.fill_null(pc.list_value_length(lists), 0)
            flat = lists.flatten()
            # A sum with 0 has no -0.
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, dtype=kind)
            wrong = ~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(lengths.to_numpy(), dtype=np.int64)]

            def number(flags: np.ndarray) -> np.ndarray:
                upto = np.r_[0, np.cumsum(flags)]
                return upto[ends[1:]] - upto[ends[:-1]]

            usable = (number(wrong) == 0) & (number(values != 0) > 0)
            raw, cuts = values.tobytes(), (ends * values.itemsize).tolist()
            vectors = [raw[a:b] if use else None for use, a, b in zip(usable.tolist(), cuts, cuts[1:])]
            digests = [None if v is None else blake2b(v, digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lengths.cast(pa.int32()), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())],
                names=["vec_id", "d", "vec", "digest"],
            )

    return plain.mapInArrow(pack, "vec_id long, d int, vec binary, digest binary"), kind


def _unit(matrix: np.ndarray) -> np.ndarray:
    # The largest component first, so that squares neither overflow nor vanish.
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _lead(matrix: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The unit vectors' coordinates on some axes, for equal vectors equal to the last bit, on whatever machine and among whatever rows."""
    scaled = np.ascontiguousarray((matrix / np.abs(matrix).max(axis=1, keepdims=True)).T)
    at, squares = np.zeros((axes.shape[1], len(matrix))), np.zeros(len(matrix))
    # One product and one sum at a time; a matrix product may round rows differently.
    for column, axis in zip(scaled, axes):
        squares += column * column
        for k in range(len(at)):
            at[k] += column * axis[k]
    return np.ascontiguousarray((at / np.sqrt(squares)).T)


def _bytes(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The values of a binary column, all of ``width`` numbers, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _axes(vectors: DataFrame, length: int, kind: str) -> DataFrame:
    """One row: the principal axes of the unit vectors and the spread along each, from moments summed up per task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(length), np.zeros((length, length))
        for batch in batches:
            unit = _unit(_bytes(batch.column("vec"), kind, length).astype(np.float64))
            n, first, second = n + len(unit), first + unit.sum(axis=0), second + unit.T @ unit
        values = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "value"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.zeros(1 + length + length * length)
        for batch in batches:
            values[batch["i"].to_numpy()] = batch["value"].to_numpy()
        mean = values[1 : 1 + length] / max(values[0], 1)
        moment = values[1 + length :].reshape(length, length) / max(values[0], 1) - np.outer(mean, mean)
        spread, axes = np.linalg.eigh(moment)
        yield pd.DataFrame({"axes": [axes[:, ::-1].ravel().tolist()], "spread": [spread[::-1].tolist()]})

    sums = vectors.select("vec").mapInArrow(moments, "i long, value double").groupBy("i").agg(F.sum("value").alias("value"))
    return sums.repartition(1).mapInPandas(solve, "axes array<double>, spread array<double>")


def _leading(spread: np.ndarray, epsilon: float) -> int:
    """How many axes leave a share of ``LEFT`` of the pairs at most, by Chernoff's bound for normal coordinates; all, if that is too much to hope for."""
    tilt = np.geomspace(1e-2, 1e6, 81)
    bound = tilt * epsilon**2
    for k, variance in enumerate(np.maximum(spread, 0), 1):
        bound = bound - np.log1p(4 * tilt * variance) / 2
        if bound.min() <= math.log(LEFT) and k % 4 == 0:
            return k
    return len(spread)


def _links(
    vectors: DataFrame, length: int, n: int, kind: str, threshold: float, base: int
) -> tuple[DataFrame, DataFrame]:
    """``node, digest, _first, _n`` of each class, and ``kind, node, other``: kind 0 counts the links of a node, kind 1 ties two nodes."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    # length x length numbers, whatever the size of the table.
    found = _axes(vectors, length, kind).first()
    axes = np.array(found["axes"]).reshape(length, length)
    leading = _leading(np.array(found["spread"]), epsilon)
    folder = scratch_dir(vectors.sparkSession)
    classes, blocks = _blocks(vectors, n, axes, kind, epsilon, folder, base)
    pairs = _close_blocks(blocks.select("block", "low", "high"), length, epsilon)
    # A number per file.
    files = [r["file"] for r in blocks.select("block", "file").orderBy("block").collect()]
    return classes, written(_compare(pairs, files, axes, leading, kind, epsilon, threshold, folder))


def _blocks(
    vectors: DataFrame, n: int, axes: np.ndarray, kind: str, epsilon: float, folder: str, base: int
) -> tuple[DataFrame, DataFrame]:
    """The sequence in epsilon grid order, cut into files of ``BLOCK`` vectors at most.

    Gives ``node, digest, _first, _n`` of the classes of equal vectors, and ``block, file, low, high``, the
    files numbered in that order with their bounding boxes. Equal vectors have the same cells and digest, so
    they meet in one range; what a batch has of them is put together before.
    """
    length = len(axes)
    size = max(1, BLOCK * WIDTH // max(WIDTH, length))
    leading = min(GRID_AXES, length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = _classes(batch, kind, length)
            rows = _merged(rows[np.lexsort(rows["digest"].T)])
            lead = _lead(rows["vec"].astype(np.float64), axes[:, :leading])
            cells = np.floor(lead / epsilon) if epsilon else np.zeros(lead.shape)
            cells = (np.clip(cells, -(2.0**31), 2.0**31 - 1) + 2.0**31).astype(">u4")
            inside = np.clip((lead + 1) * 2.0**15, 0, 2.0**16 - 1).astype(">u2")
            key = np.hstack([cells.view(np.uint8), inside.view(np.uint8)])
            yield pa.RecordBatch.from_arrays(
                [
                    _binary(key),
                    _binary(rows["digest"].view(np.uint8)),
                    pa.array(rows["first"], mask=~rows["named"]),
                    pa.array(rows["n"]),
                    _binary(np.ascontiguousarray(rows["vec"]).view(np.uint8)),
                ],
                names=["key", "digest", "vec_id", "n", "vec"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = base + TaskContext.get().partitionId()
        held = np.zeros(0, dtype=_row(kind, length))
        done = 0

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal done
            node = (part << 33) + done + np.arange(len(rows))
            # Files of a range are told by their first row in it.
            file, done = int(node[0]), done + len(rows)
            low, high = _write_block(folder, file, node, rows, axes)
            none = [None] * (len(rows) - 1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(node),
                    _binary(rows["digest"].view(np.uint8)),
                    pa.array(rows["first"], mask=~rows["named"]),
                    pa.array(rows["n"]),
                    pa.array([file, *none], pa.int64()),
                    pa.array([low, *none], pa.list_(pa.float64())),
                    pa.array([high, *none], pa.list_(pa.float64())),
                ],
                names=["node", "digest", "_first", "_n", "file", "low", "high"],
            )

        for batch in batches:
            if len(batch):
                held = _merged(np.concatenate([held, _classes(batch, kind, length)]))
            # The last class may go on in the next batch.
            while len(held) > size:
                yield flush(held[:size])
                held = held[size:]
        if len(held):
            yield flush(held)

    placed = vectors.select("digest", "vec_id", F.lit(1).cast("long").alias("n"), "vec").mapInArrow(
        place, "key binary, digest binary, vec_id long, n long, vec binary"
    )
    ranged = placed.repartitionByRange(max(1, -(-n // (2 * size))), "key", "digest").sortWithinPartitions("key", "digest")
    out = written(
        ranged.mapInArrow(
            write, "node long, digest binary, _first long, _n long, file long, low array<double>, high array<double>"
        )
    )
    # A row per file.
    order = Window.orderBy("file")
    boxes = out.filter("file IS NOT NULL").select(
        (F.row_number().over(order) - 1).cast("long").alias("block"), "file", "low", "high"
    )
    return out.select("node", "digest", "_first", "_n"), written(boxes)


def _row(kind: str, length: int) -> np.dtype:
    """A class of equal vectors: the smallest id, if there is one, and the number of rows."""
    return np.dtype([("digest", "<u8", 2), ("first", "<i8"), ("named", "?"), ("n", "<i8"), ("vec", kind, length)])


def _classes(batch: pa.RecordBatch, kind: str, length: int) -> np.ndarray:
    rows = np.empty(len(batch), dtype=_row(kind, length))
    rows["digest"] = _bytes(batch.column("digest"), "<u8", 2)
    rows["first"] = batch.column("vec_id").fill_null(_LAST).to_numpy()
    rows["named"] = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    rows["n"] = batch.column("n").to_numpy()
    rows["vec"] = _bytes(batch.column("vec"), kind, length)
    return rows


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows of one class that stand together, as one."""
    digest = rows["digest"]
    starts = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)])
    if len(starts) == len(rows):
        return rows
    out = rows[starts]
    out["first"] = np.minimum.reduceat(rows["first"], starts)
    out["named"] = np.logical_or.reduceat(rows["named"], starts)
    out["n"] = np.add.reduceat(rows["n"], starts)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    raw, width = rows.tobytes(), rows.size // max(1, len(rows))
    return pa.array([raw[a : a + width] for a in range(0, len(raw), width)], pa.binary())


def _path(root: str, file: int) -> str:
    return f"{root}/block-{file:016x}.bin"


def _write_block(folder: str, file: int, node: np.ndarray, rows: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the file of a block and give its bounding box.

    It has the number of rows, nodes, numbers of rows of each class, bounding boxes of the parts, and vectors.
    It appears under its name when it is whole; a repeated task puts the same bytes there again.
    """
    from pyarrow import fs

    at = _unit(rows["vec"].astype(np.float64)) @ axes
    # Parts of a block are cut in the same order.
    order = np.lexsort(at[:, : min(3, len(axes))].T[::-1])
    at = at[order]
    starts = np.arange(0, len(at), PART)
    low, high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for values in (np.array([len(rows)]), node[order], rows["n"][order], low, high, rows["vec"][order]):
            out.write(np.ascontiguousarray(values).tobytes())
    store.move(draft, _path(root, file))
    return low.min(axis=0), high.max(axis=0)


def _close_blocks(boxes: DataFrame, length: int, epsilon: float) -> DataFrame:
    """``i, j`` with i <= j: the pairs of blocks whose boxes are within epsilon, found level by level."""
    levels = [boxes]
    top = boxes.agg(F.max("block")).first()[0]
    while top > 0:
        parent = F.expr(f"block div {FANOUT}")
        levels.append(
            written(
                levels[-1].groupBy(parent.alias("block")).agg(
                    F.array(*[F.min(F.col("low")[i]) for i in range(length)]).alias("low"),
                    F.array(*[F.max(F.col("high")[i]) for i in range(length)]).alias("high"),
                )
            )
        )
        top //= FANOUT
    spark = boxes.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    children = F.sequence(F.lit(0), F.lit(FANOUT - 1))
    for level in reversed(range(len(levels) - 1)):
        split = (
            pairs.select(F.explode(children).alias("_a"), "i", "j")
            .select(F.explode(children).alias("_b"), (F.col("i") * FANOUT + F.col("_a")).alias("i"), "j")
            .select("i", (F.col("j") * FANOUT + F.col("_b")).alias("j"))
            .filter("i <= j")
        )
        left = levels[level].select(F.col("block").alias("_i"), F.col("low").alias("_li"), F.col("high").alias("_hi"))
        right = levels[level].select(F.col("block").alias("_j"), F.col("low").alias("_lj"), F.col("high").alias("_hj"))
        gap = F.zip_with(
            F.zip_with("_li", "_hj", lambda a, b: a - b),
            F.zip_with("_lj", "_hi", lambda a, b: a - b),
            lambda a, b: F.greatest(a, b, F.lit(0.0)),
        )
        apart = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
        pairs = written(
            split.join(left, F.col("i") == F.col("_i"))
            .join(right, F.col("j") == F.col("_j"))
            .filter(apart <= (epsilon + SLACK) ** 2)
            .select("i", "j")
        )
    return pairs


def _compare(
    pairs: DataFrame, files: list[int], axes: np.ndarray, leading: int, kind: str, epsilon: float, threshold: float, folder: str
) -> DataFrame:
    """Compare the vectors of the pairs of blocks, a tile of pairs in a task."""
    side = max(1, min(TILE, len(files) // 16))
    tiles = written(
        pairs.groupBy(F.expr(f"i div {side}").alias("_i"), F.expr(f"j div {side}").alias("_j")).agg(
            F.sort_array(F.collect_list((F.col("i") * len(files) + F.col("j")))).alias("pairs")
        )
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def side_of(block: int) -> _Side:
            with store.open_input_stream(_path(root, files[block])) as source:
                return _Side(source.read(), axes, leading, kind)

        for batch in batches:
            for packed in batch["pairs"]:
                yield _compare_tile([divmod(int(x), len(files)) for x in packed], side_of, epsilon, threshold)

    # A task for each tile: their number is told, so that small rows do not bring large work together.
    n = max(1, tiles.count())
    return tiles.repartitionByRange(n, "_i", "_j").select("pairs").mapInPandas(compare, "kind int, node long, other long")


class _Side:
    """A block as a sequence of parts with bounding boxes."""

    def __init__(self, data: bytes, axes: np.ndarray, leading: int, kind: str):
        length = len(axes)
        (n,) = np.frombuffer(data, dtype=np.int64, count=1)
        self.parts = [(a, min(a + PART, n)) for a in range(0, n, PART)]
        numbers = np.frombuffer(data, dtype=np.int64, offset=8, count=2 * n).reshape(2, n)
        boxes = np.frombuffer(data, dtype=np.float64, offset=8 + 16 * n, count=2 * len(self.parts) * length)
        self.node, self.n = numbers
        self.low, self.high = boxes.reshape(2, len(self.parts), length)
        self.vectors = np.frombuffer(data, dtype=kind, offset=8 + 16 * n + boxes.nbytes).reshape(n, length)
        # The length of the rest stands for the coordinates that are left out.
        head = self.unit(slice(None)) @ axes[:, :leading]
        rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1, keepdims=True)))
        self.head = np.hstack([head, rest]).astype(np.float32)

    def unit(self, rows) -> np.ndarray:
        return _unit(self.vectors[rows].astype(np.float64))


def _compare_tile(
    pairs: list[tuple[int, int]], side_of: Callable[[int], _Side], epsilon: float, threshold: float
) -> pd.DataFrame:
    sides = {block: side_of(block) for block in sorted({b for pair in pairs for b in pair})}
    base, total = {}, 0
    for block, side in sides.items():
        base[block], total = total, total + len(side.node)
    nodes = np.concatenate([side.node for side in sides.values()])
    links, tied = np.zeros(total, dtype=np.int64), _Forest(total)
    for i, j in pairs:
        one, other = sides[i], sides[j]
        links_one, links_other, left, right = _compare_sides(one, other, epsilon, threshold)
        links[base[i] : base[i] + len(one.node)] += links_one
        links[base[j] : base[j] + len(other.node)] += links_other
        at = np.r_[base[i] + np.arange(len(one.node)), base[j] + np.arange(len(other.node))]
        tied.join(at[left], at[right])
    has = np.flatnonzero(links)
    left, right = tied.ties()
    return pd.DataFrame(
        {
            "kind": np.r_[np.zeros(len(has), dtype=np.int32), np.ones(len(left), dtype=np.int32)],
            "node": np.r_[nodes[has], nodes[left]].astype(np.int64),
            "other": np.r_[links[has], nodes[right]].astype(np.int64),
        }
    )


def _compare_sides(
    one: _Side, other: _Side, epsilon: float, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The links of each vector of both sides, and ties of places, those of ``other`` after those of ``one``."""
    same = one is other
    links_one, links_other = np.zeros(len(one.node), dtype=np.int64), np.zeros(len(other.node), dtype=np.int64)
    tied = _Forest(len(one.node) + (0 if same else len(other.node)))
    shift = 0 if same else len(one.node)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        rows, columns = (np.concatenate(places) for places in zip(*found))
        np.add.at(links_one, rows, other.n[columns])
        np.add.at(links_other, columns, one.n[rows])
        tied.join(rows, columns + shift)
        found.clear()

    # By Cauchy and Schwarz no cosine is larger than the product of the heads but for single precision.
    least = threshold - 1e-6 * (16 + one.head.shape[1])
    waiting, units = 0, {}
    for p, (a, b) in enumerate(one.parts):
        gaps = np.maximum(0, np.maximum(one.low[p] - other.high, other.low - one.high[p]))
        near = (gaps * gaps).sum(axis=1) <= (epsilon + SLACK) ** 2
        unit = None
        for q in np.flatnonzero(near):
            if same and q < p:
                continue
            c, d = other.parts[q]
            most = one.head[a:b] @ other.head[c:d].T
            if most.max() < least:
                continue
            rows, columns = np.divmod(np.flatnonzero(most >= least), d - c)
            if len(rows) <= FEW:
                links = (one.unit(a + rows) * other.unit(c + columns)).sum(axis=1) >= threshold
                rows, columns = rows[links], columns[links]
            else:
                unit = one.unit(slice(a, b)) if unit is None else unit
                if q not in units:
                    units[q] = other.unit(slice(c, d))
                rows, columns = np.nonzero(unit @ units[q].T >= threshold)
            if same and p == q:
                once = rows < columns
                rows, columns = rows[once], columns[once]
            if len(rows):
                found.append((a + rows, c + columns))
                waiting += len(rows)
                if waiting >= MANY:
                    settle()
                    waiting = 0
    if found:
        settle()
    return links_one, links_other, *tied.ties()


class _Forest:
    """Which places of some blocks hang together."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join places: labels sink to the smallest until nothing moves."""
        while True:
            differ = self.label[a] != self.label[b]
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            np.minimum.at(self.label, high, low)
            while True:
                deeper = self.label[self.label]
                if (deeper == self.label).all():
                    break
                self.label = deeper

    def ties(self) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(self.label != np.arange(len(self.label)))
        return places, self.label[places]
