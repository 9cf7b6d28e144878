"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is four segments of 16 on a ring. If two fingerprints
differ in at most ``LIMIT`` = 3 bits, the differences per segment sum up to 3, and
by the pigeonring principle some segment starts a chain that stays within its
share all along: the first segment differs in at most 3/4 of a bit, so in none, the
first two in at most 6/4, so in one, the first three in at most 9/4, so in two. The
first two steps are the join key: a fingerprint is entered, for each of the four
starts, under its first segment and each form of the second that differs in one bit
at most. The later steps are tested on the pairs that meet, before the full count.

Equal fingerprints are one node from the start, and a bucket gives back a spanning
forest of its links rather than its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import connected_components
from millrace.llm.tables import written

LIMIT = 3
SEGMENTS = 4
# Runs of equal keys up to this length are paired row by row in one go.
SHORT_RUN = 9


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint of a text: unsigned, zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for word in words:
            at += 1 + len(word)
            ends.append(at)
        starts = [0] + [end + 1 for end in ends[:-1]]
        shingles = [joined[a:b] for a, b in zip(starts, ends[words_per_shingle - 1 :])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=len(shingles))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_280):
        part = hashes[i : i + 65_280]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        # Sums of 255 bits fit in a byte, which adds up without widening.
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3):
    """``doc_id, fp``; ``fp`` is the fingerprint as a signed long. Whole texts, null like an empty one."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [fingerprint(t if isinstance(t, str) else None, words_per_shingle) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array(values, dtype=np.uint64).view(np.int64)}
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(compute, "doc_id long, fp long")


def fingerprint_of(text: str) -> Column:
    """The fingerprint of a column of texts, as a signed long."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t if isinstance(t, str) else None) for t in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))

    return compute(F.col(text))


def chain_keys(nodes: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint under its chain keys, 17 for each of the four starts."""

    def segment(i: int):
        return F.shiftrightunsigned("fp", 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))

    flips = F.array(F.lit(0), *[F.lit(1 << bit) for bit in range(16)])
    starts = F.array(
        *[
            F.lit(i << 32).bitwiseOR(F.shiftleft(segment(i), 16)).bitwiseOR(segment(i + 1))
            for i in range(SEGMENTS)
        ]
    )
    return nodes.select("fp", F.explode(starts).alias("_start")).select(
        F.explode(F.transform(flips, lambda flip: F.col("_start").bitwiseXOR(flip.cast("long")))).alias("key"), "fp"
    )


def _chain_holds(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Do the chains from ``start`` stay within their budgets, and the whole within the limit?"""
    differ = x ^ y
    low = (16 * start).astype(np.uint64)
    turned = np.where(low == 0, differ, (differ >> low) | (differ << ((np.uint64(64) - low) & np.uint64(63))))
    ok = (turned & np.uint64(0xFFFF)) == 0
    ok &= np.bitwise_count(turned & np.uint64(0xFFFFFFFF)) <= 1
    ok &= np.bitwise_count(turned & np.uint64(0xFFFFFFFFFFFF)) <= 2
    return ok & (np.bitwise_count(turned) <= LIMIT)


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within each run of equal ``keys``; ``keys`` are sorted."""
    n = len(keys)
    if n < 2:
        return fps[:0], fps[:0]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, n])
    left, right = [], []
    short = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    for shift in range(1, min(SHORT_RUN, n)):
        i = np.flatnonzero(short[shift:] & (keys[shift:] == keys[:-shift]))
        if not len(i):
            break
        ok = _chain_holds(fps[i], fps[i + shift], keys[i] >> np.uint64(32))
        left.append(fps[i[ok]])
        right.append(fps[i[ok] + shift])
    for run in np.flatnonzero(length > SHORT_RUN):
        a, b = first[run], first[run] + length[run]
        tied = _spanning_links(np.unique(fps[a:b]), keys[a] >> np.uint64(32))
        left.append(tied[0])
        right.append(tied[1])
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _spanning_links(members: np.ndarray, start: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest: what a member reaches leaves the pool, so a dense group costs few passes over it."""
    pool, left, right = members, [], []
    while len(pool):
        frontier, pool = [pool[0]], pool[1:]
        while frontier and len(pool):
            x = frontier.pop()
            ok = _chain_holds(np.full(len(pool), x), pool, np.full(len(pool), start))
            if ok.any():
                reached = pool[ok]
                left.append(np.full(len(reached), x))
                right.append(reached)
                frontier.extend(reached)
                pool = pool[~ok]
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` within the limit."""

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_keys, held = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate([held_keys, batch["key"].to_numpy().astype(np.uint64)])
            fps = np.concatenate([held, batch["fp"].to_numpy().view(np.uint64)])
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            held_keys, held = keys[cut:], fps[cut:]
            a, b = bucket_links(keys[:cut], fps[:cut])
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        a, b = bucket_links(held_keys, held)
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # Fingerprints are small and their keys many: as many tasks make keys as will sort them.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = chain_keys(spread).repartition("key").sortWithinPartitions("key")
    return met.mapInPandas(connect, "a long, b long").distinct()


def classes(marked: DataFrame) -> DataFrame:
    """``_fp, _root, component_id`` of each distinct ``fp``; ``_root`` names the component, also one without ids."""
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = named.groupBy("root").agg(F.min("_first").alias("component_id")).withColumnRenamed("root", "_root")
    return named.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "_root", "component_id"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``fingerprint`` is 16 lowercase hexadecimal digits, ``component_id`` the smallest
    id that can be reached over links of at most three differing bits. Null and empty
    texts have fingerprint zero and link like any other. Rows that repeat are rows of
    their own with one id; a row without an id takes part with its text and gets the
    smallest id of its component, null if none has any. Empty tables give empty results.
    """
    marked = written(fingerprints(docs, id_col, text_col))
    return marked.join(classes(marked), F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
