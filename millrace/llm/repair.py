"""Conversation structure repair: the cheapest edits that give a conversation the roles of a grammar.

The grammar is ``(s?(ua)+)?``: nothing, or user and assistant by turns, with a system row
before them or not. Rows are aligned to its strings by the edit distance of Wagner and
Fischer. All targets of even length are ends of one alternating string, so one matrix of
costs-to-go serves every feasible length: entry (row, t) is the cost of giving the rows
from that one on the last t roles. A target that begins with a system row keeps one of
the rows, deletes those before it and goes on in the same matrix.

Only a band of the matrix is made: a column is left out where the inserts or deletes that
are still due cost more than may be spent (Ukkonen). That is little at first and doubled
until the cost found is within it, up to the incumbent, the cost of going along the
diagonal. The backtrace goes forward; the audits of all targets of least cost are
compared edit by edit, and those that go on with the least edit in ASCII order stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
# Bands up to this width go through plain lists, wider ones through arrays.
_NARROW = 48
# What the first band may spend on inserts, deletes that are not due and new roles.
_FIRST_SPARE = 6
# Entries of the matrix that are kept at a time.
_ENTRIES = 4_000_000


class Repair(NamedTuple):
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    rows: list[tuple[str, str]]


def faults(rows: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): ``blank``, ``duplicate``, ``truncated`` or none."""
    seen, found = set(), []
    for row in rows:
        last = _LAST.search(row[1])
        if last is None:
            found.append("blank")
        elif row in seen:
            found.append("duplicate")
        else:
            found.append("" if last[0] in ".!?" else "truncated")
        seen.add(row)
    return found


def repair(rows: Sequence[tuple[str, str]]) -> Repair:
    """The faults of the rows (role, text), and the edits of least cost, of equal ones those with the least audit."""
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = _edits(initials, found)
    return Repair(
        found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, _applied(rows, audit)
    )


def _edits(initials: list[str], found: list[str]) -> tuple[int, str]:
    """Least cost and least audit. The band is doubled until what it may spend covers the cost found in it."""
    must = [fault in ("blank", "duplicate") for fault in found]
    extra = [TRUNCATED * (fault == "truncated") for fault in found]
    base, most = DELETE * sum(must) + sum(extra), _incumbent(initials, must, extra)
    spare = _FIRST_SPARE
    while True:
        matrix = _Matrix(initials, must, extra, min(base + spare, most))
        least, options = matrix.cheapest()
        if least <= matrix.most:
            return least, matrix.trace(options)
        spare *= 2


def _incumbent(initials: list[str], must: list[bool], extra: list[int]) -> int:
    """Cost of a repair without inserts, but for one at the end, and without deletes that are not due, or of deleting all."""
    least = DELETE * len(initials)
    for start in (0, 1):
        cost, at = DELETE * sum(must), 0
        for i, initial in enumerate(initials):
            if must[i]:
                continue
            cost += extra[i]
            if start and not at:
                if initial != "s":
                    break
            else:
                cost += REROLE * (initial != "ua"[(at - start) % 2])
            at += 1
        else:
            if at > start:
                least = min(least, cost + INSERT * ((at - start) % 2))
    return least


class _Matrix:
    """Costs-to-go ``at(row, t)`` inside the band; beyond it they are above the incumbent."""

    def __init__(self, initials: list[str], must: list[bool], extra: list[int], most: int):
        self.n, self.initials, self.must, self.extra, self.most = len(initials), initials, must, extra, most
        # Rows that may stay from each row on.
        self.stay = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            self.stay[i] = self.stay[i + 1] + (not must[i])
        # An insert, or a delete that is not due, costs so much more than what each row costs at least.
        spare = most - DELETE * sum(must) - sum(extra)
        self.below, self.above = spare // (DELETE - TRUNCATED), spare // INSERT
        self.width = self.below + self.above + 1
        self.block = max(1, _ENTRIES // self.width)
        self.kept: dict[int, list[int] | np.ndarray] = {}
        self._make()

    def _low(self, row: int) -> int:
        """The column at the first place of a row of the band; it may lie below zero."""
        return self.stay[row] - self.below

    def columns(self, row: int) -> range:
        low = self._low(row)
        return range(max(0, low), low + self.width)

    def _make(self) -> None:
        row = self._last()
        self._keep(self.n, row)
        for i in range(self.n - 1, -1, -1):
            row = self._next(i, row)
            self._keep(i, row)

    def _keep(self, i: int, row) -> None:
        # The first block of rows, and one row of each other block to make it again from.
        if i <= self.block or i % self.block == 0 or i == self.n:
            self.kept[i] = row

    def _row(self, i: int):
        if i not in self.kept:
            top = min(self.n, -(-i // self.block) * self.block)
            row = self.kept[top]
            for j in [j for j in self.kept if j % self.block and j != self.n]:
                del self.kept[j]
            for j in range(top - 1, top - self.block, -1):
                if j < 0:
                    break
                row = self._next(j, row)
                self.kept[j] = row
        return self.kept[i]

    def _last(self):
        low = self._low(self.n)
        row = [INSERT * t if t >= 0 else self.most + 1 for t in range(low, low + self.width)]
        return row if self.width <= _NARROW else np.array(row, dtype=np.int64)

    def _next(self, i: int, below):
        """The row above ``below``; places where nothing can be are above the incumbent."""
        far, low, width = self.most + 1, self._low(i), self.width
        if self.must[i]:
            # Same columns, and one more delete; inserts before it cost what they cost after it.
            if isinstance(below, list):
                return [x + DELETE for x in below]
            return below + DELETE
        initial, extra = self.initials[i], self.extra[i]
        # Place k is column low + k; below, that column is at k + 1.
        if isinstance(below, list):
            row = []
            before = far
            for k in range(width):
                t = low + k
                if t < 0:
                    row.append(far)
                    continue
                best = before + INSERT if t else far
                if k + 1 < width and below[k + 1] + DELETE < best:
                    best = below[k + 1] + DELETE
                if t:
                    take = below[k] + extra + (0 if initial == "au"[t % 2 == 0] else REROLE)
                    if take < best:
                        best = take
                before = best if best < far else far
                row.append(before)
            return row
        t = np.arange(low, low + width)
        take = below + extra + np.where(initial == "a", np.where(t % 2, 0, REROLE), np.where(t % 2, REROLE, 0) if initial == "u" else REROLE)
        row = np.minimum(np.where(t > 0, take, far), np.r_[below[1:], far - DELETE] + DELETE)
        row[t < 0] = far
        # Inserts: the least of all entries to the left, and what lies between.
        steps = INSERT * np.arange(width)
        return np.minimum(np.minimum.accumulate(row - steps) + steps, far)

    def at(self, i: int, t: int) -> int:
        k = t - self._low(i)
        return int(self._row(i)[k]) if t >= 0 and 0 <= k < self.width else self.most + 1

    def cheapest(self) -> tuple[int, list[tuple[int, int]]]:
        """Least cost, and the targets that have it: the row that is kept as the system row, or -1, and the length."""
        least, options = self.most + 1, []
        for system in [-1, *(i for i, initial in enumerate(self.initials) if initial == "s" and not self.must[i])]:
            if DELETE * system > self.most:
                break
            lead = 0 if system < 0 else DELETE * system + self.extra[system]
            for t in self.columns(system + 1):
                if t % 2 == 0 and (t or system < 0):
                    cost = lead + self.at(system + 1, t)
                    if cost < least:
                        least, options = cost, []
                    if cost == least and cost <= self.most:
                        options.append((system, t))
        return least, options

    def trace(self, options: list[tuple[int, int]]) -> str:
        """The least audit of all targets. They are traced side by side: those with the same audit
        so far are at the same row, and the ones that cannot go on with the least edit drop out."""
        audit, i = [], 0
        while not any(t == 0 and system < i and i == self.n for system, t in options):
            ways: dict[str, set[tuple[int, int]]] = {"D": set(), "I": set(), "K": set(), "R": set()}
            for system, t in options:
                if system >= i:
                    # Before the row that is kept as the system row.
                    ways["K" if system == i else "D"].add((system, t))
                    continue
                cost = self.at(i, t)
                if i < self.n and self.at(i + 1, t) + DELETE == cost:
                    ways["D"].add((-1, t))
                if t and self.at(i, t - 1) + INSERT == cost:
                    ways["I"].add((-1, t - 1))
                if t and i < self.n and not self.must[i]:
                    keeps = self.initials[i] == "au"[t % 2 == 0]
                    if self.at(i + 1, t - 1) + self.extra[i] + REROLE * (not keeps) == cost:
                        ways["K" if keeps else "R"].add((-1, t - 1))
            edit = next(edit for edit in "DIKR" if ways[edit])
            options = sorted(ways[edit])
            audit.append(edit)
            i += edit != "I"
        return "".join(audit)


def _applied(rows: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit, which says all: roles alternate from the first user on."""
    out: list[tuple[str, str]] = []
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        due = ROLES["a" if out and out[-1][0][:1] == "u" else "u"]
        if edit == "I":
            out.append((due, ""))
            continue
        role, text = rows[at]
        out.append((role if edit == "K" else due, text))
        at += 1
    return out


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies_col: str | None = None,
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` of every conversation.

    Rows go by ``turn``, null first; ties by role and text. A null role or text is one
    blank. ``gaps`` are turns that are missing between the least and the greatest, nulls not
    counted. ``repaired`` are the rows after the edits as an array of (role, text).
    ``copies_col`` names a number of times that each row is there; a conversation all of whose
    rows are there 0 times is repaired as one without rows: zeros, an empty audit, no
    rows. Rows without a conversation id are one conversation. Rows that repeat are
    duplicates; other columns are not looked at; an empty table gives an empty result.

    A conversation is one alignment, and so one task's work; its rows come sorted by
    Spark as a stream. The matrix is kept in blocks of bounded size, and made again
    block by block for the backtrace.
    """

    def finish(conv_id, turns: list, rows: list[tuple[str, str]]) -> tuple:
        known = [turn for turn in turns if turn is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        done = repair(rows)
        return (conv_id, gaps, *done[:6], [{"role": role, "text": text} for role, text in done.rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
        key, begun, turns, rows, out, size = None, False, [], [], [], 0

        def result() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

        for batch in batches:
            ids = [None if i is pd.NA else int(i) for i in batch["conv_id"].astype("Int64")]
            places = [None if i is pd.NA else int(i) for i in batch["turn"].astype("Int64")]
            for conv_id, turn, role, text, copies in zip(ids, places, batch["role"], batch["text"], batch["copies"]):
                if begun and conv_id != key:
                    out.append(finish(key, turns, rows))
                    size += sum(len(text) for _, text in rows) + 100
                    turns, rows = [], []
                    if size > 1_000_000:
                        yield result()
                        out, size = [], 0
                key, begun = conv_id, True
                turns += [turn] * copies
                rows += [(role, text)] * copies
        if begun:
            out.append(finish(key, turns, rows))
            yield result()

    plain = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.col(copies_col).cast("int"), F.lit(0)).alias("copies") if copies_col else F.lit(1).alias("copies"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return (
        plain.repartition("conv_id")
        .sortWithinPartitions(*order)
        .mapInPandas(
            run,
            "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired array<struct<role string, text string>>",
        )
    )
