"""Token ids in files that answer access, count and occurrence queries: a wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its planes, one per bit of an id
from the highest, hold the bits of all ids, stably parted by the bits of the planes
above, zeros first. Rank and select on the planes give the id at a place, how often
an id occurs up to a place, and where its j-th occurrence is, each in a few steps
per plane.

File format, all integers little-endian: the magic ``WVMX0001``; a header length
(4 bytes); the header in JSON (``n`` ids, ``bits`` planes, ``docs``, ``zeros`` of each
plane, ``id`` type, ``sections`` with offset and length in the body); the body. Sections:
``doc_ids`` (8-byte integers; ``doc_nulls`` one byte each) and ``ends`` (8-byte ends
of the documents), and for each plane blocks of ``BLOCK`` bits and the ones before each
block. Every section is compressed on its own, so a query reads the blocks it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.llm.tables import written
from millrace.llm.tokens import encoder, text_chunks, tokenizer_path
from millrace.sinks.scratch import scratch_dir

MAGIC = b"WVMX0001"
BLOCK = 1 << 19  # bits
SHARD_IDS = 1 << 21


def encode_shard(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, doc_nulls: np.ndarray, bits: int) -> bytes:
    """The bytes of one file. ``ids`` is an unsigned array, ``ends`` where each document ends in it."""
    pack = zstandard.ZstdCompressor(level=1).compress
    sections: dict[str, list] = {}
    body: list[bytes] = []
    at = 0

    def add(name: str, raw: bytes) -> None:
        nonlocal at
        data = pack(raw)
        sections[name] = [at, len(data)]
        body.append(data)
        at += len(data)

    add("doc_ids", doc_ids.astype("<i8").tobytes())
    add("doc_nulls", doc_nulls.astype(np.uint8).tobytes())
    add("ends", ends.astype("<i8").tobytes())
    zeros, level = [], ids
    for plane in range(bits):
        ones = (level & level.dtype.type(1 << (bits - 1 - plane))) != 0
        packed = np.packbits(ones, bitorder="little")
        before = []
        total = 0
        for k, start in enumerate(range(0, len(packed), BLOCK // 8)):
            block = packed[start : start + BLOCK // 8]
            before.append(total)
            total += int(np.bitwise_count(block).sum(dtype=np.int64))
            add(f"{plane}.{k}", block.tobytes())
        add(f"{plane}.ones", np.array(before, dtype="<i8").tobytes())
        zeros.append(len(level) - total)
        mask = pa.Array.from_buffers(pa.bool_(), len(level), [None, pa.py_buffer(packed)])
        parted = [pc.filter(pa.array(level), bits_set).to_numpy() for bits_set in (pc.invert(mask), mask)]
        level = np.concatenate(parted)
    header = json.dumps(
        {"n": len(ids), "bits": bits, "docs": len(doc_ids), "zeros": zeros, "id": ids.dtype.str, "sections": sections}
    ).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(body)


class WaveletShard:
    """Queries on the bytes of one file. Blocks are unpacked when they are needed, and a few are kept."""

    def __init__(self, data: bytes, kept_blocks: int = 64):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", data[8:12])
        header = json.loads(data[12 : 12 + size])
        self._data, self._body, self._sections = data, 12 + size, header["sections"]
        self.n, self.bits, self.zeros = header["n"], header["bits"], header["zeros"]
        self._type = np.dtype(header["id"])
        nulls = np.frombuffer(self._section("doc_nulls"), dtype=np.uint8)
        ids = np.frombuffer(self._section("doc_ids"), dtype="<i8")
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, nulls)]
        self.ends = np.frombuffer(self._section("ends"), dtype="<i8")
        self._block = lru_cache(kept_blocks)(self._read_block)
        self._ones = lru_cache(None)(lambda plane: np.frombuffer(self._section(f"{plane}.ones"), dtype="<i8"))

    def _section(self, name: str) -> bytes:
        start, length = self._sections[name]
        return zstandard.ZstdDecompressor().decompress(self._data[self._body + start : self._body + start + length])

    def _read_block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        block = np.frombuffer(self._section(f"{plane}.{k}"), dtype=np.uint8)
        return block, np.r_[0, np.cumsum(np.bitwise_count(block), dtype=np.int64)]

    def _bit(self, plane: int, i: int) -> int:
        block, _ = self._block(plane, i // BLOCK)
        return int(block[i % BLOCK // 8] >> (i & 7)) & 1

    def _rank(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, upto = self._block(plane, i // BLOCK)
        byte = i % BLOCK // 8
        inside = int(block[byte]) & ((1 << (i & 7)) - 1)
        return int(self._ones(plane)[i // BLOCK] + upto[byte]) + inside.bit_count()

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the ``j``-th (from 0) bit of this value in a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank(plane, middle + 1)
            if (ones if bit else middle + 1 - ones) > j:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit, ones = self._bit(plane, i), self._rank(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def count(self, token: int, end: int | None = None) -> int:
        """How often ``token`` occurs before place ``end``."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, min(end, self.n)
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._rank(plane, low), self._rank(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def occurrence(self, token: int, j: int) -> int:
        """The place of the ``j``-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(j)
        i = low + j
        for plane in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the planes from the lowest up undo the parting of each."""
        level = np.zeros(self.n, dtype=self._type)
        for plane in reversed(range(self.bits)):
            blocks = [self._section(f"{plane}.{k}") for k in range(-(-self.n // BLOCK))]
            packed = np.frombuffer(b"".join(blocks), dtype=np.uint8)
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            below = level
            level = np.empty_like(below)
            level[~ones] = below[: self.zeros[plane]]
            level[ones] = below[self.zeros[plane] :] | level.dtype.type(1 << (self.bits - 1 - plane))
        return level


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write ``docs`` in ascending id order and return the manifest ``shard, path, docs, ids``.

    ``folder`` lies on storage that all executors reach, by any URI that Arrow's file
    systems know. Ids sort null first; rows of one id sort by their text. Null and
    empty texts are documents of the end id alone. Ranges are of ids and the first 16
    characters, so rows of one id spread over tasks unless their texts begin alike. A shard ends with the document
    that fills it, so a very long text makes one long shard. A file appears under
    its name when it is whole; a repeated task puts the same bytes there again.
    Other columns are not looked at; an empty table writes nothing.
    """
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        bits = max(1, int(max(encode.vocabulary_size - 1, end_id)).bit_length())
        kind = np.dtype("<u2") if bits <= 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        held: list[np.ndarray] = []
        held_ids: list[int | None] = []
        size = number = 0

        def flush() -> pd.DataFrame:
            nonlocal held, held_ids, size, number
            ends = np.cumsum([len(h) for h in held])
            nulls = np.array([i is None for i in held_ids])
            ids = np.array([0 if i is None else i for i in held_ids], dtype=np.int64)
            data = encode_shard(np.concatenate(held), ends, ids, nulls, bits)
            name = f"{root}/shard-{part:06d}-{number:06d}.wvm"
            draft = f"{root}/_draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, name)
            row = (part * 1_000_000 + number, f"{folder}/shard-{part:06d}-{number:06d}.wvm", len(held), int(ends[-1]))
            held, held_ids, size, number = [], [], 0, number + 1
            return pd.DataFrame([row], columns=["shard", "path", "docs", "ids"])

        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            names = [None if i is pd.NA else int(i) for i in batch["doc_id"].astype("Int64")]
            for run in text_chunks(texts):
                for k, raw in zip(run, encode.encode([texts[k] for k in run])):
                    held.append(np.frombuffer(raw + end, dtype="<u4").astype(kind))
                    held_ids.append(names[k])
                    size += len(held[-1])
                    if size >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # How texts begin deals out rows of one id, or without any, and agrees with the order.
    ranged = plain.repartitionByRange(order[0], F.substring("text", 1, 16).asc_nulls_first()).sortWithinPartitions(*order)
    return written(ranged.mapInPandas(write, "shard long, path string, docs long, ids long"))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read back from the files.

    ``start`` counts the ids of all documents before it, ``ids`` is binary: unsigned
    32-bit little-endian. The running sum over shards has one row per file.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["_base"]):
                store, name = _filesystem(path)
                with store.open_input_stream(name) as source:
                    shard = WaveletShard(source.read())
                ids, first = shard.ids().astype("<u4"), 0
                for at in range(0, len(shard.ends), 256):
                    out = []
                    for doc_id, end in zip(shard.doc_ids[at : at + 256], shard.ends[at : at + 256].tolist()):
                        out.append((doc_id, int(base) + first, end - first, ids[first:end].tobytes()))
                        first = end
                    yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("_base", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).select("path", "_base", "shard")
    # A task for each file: their number is told, so that small rows do not bring large files together.
    files = max(1, manifest.count())
    return based.repartitionByRange(files, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and read them back."""
    spark = docs.sparkSession
    return read_documents(spark, write_shards(docs, scratch_dir(spark), **options))
