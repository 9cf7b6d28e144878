"""Line dedup by an exact set-similarity join.

A line is the set of its words, lower case. Two lines match if the Jaccard similarity
of their sets is at least ``threshold``, and a line that matches an earlier one, in the
order of document id, text and line number, is removed, whether the earlier one stays
or not. So the result does not hang on the order of work.

The words of a line are ordered by rarity. Lines that match share one of their first
n - ceil(threshold n) + 1 words, the prefix; so lines meet at the words of their
prefixes, pairs go on if their lengths and the places of the word allow enough
common words, and are then verified on their whole sets. Lines without words are
never compared and stay.

Rarity is counted in 2**18 buckets of word hashes over all documents, a table of one
size for any corpus; words are ordered by the count of their bucket, then by hash.
Sets are compared by 64-bit hashes of words. Each line also carries the parities of its
words in 64 bit places: the places in which two lines differ are a lower bound of the
words that only one of them has, which drops most pairs that only share a rare word. Long
lines would differ in half of 64 places at most, so those of more than ``WIDE`` words carry 128.
Equal sets are told by 128-bit hashes and merged over the whole corpus before any word is
entered: within tasks, then by hash. So a line that a third of the corpus repeats is sent
by each task a few times, and enters its words once.

A word that many different lines have in their prefixes is dealt in blocks of about
``BLOCK`` lines; each pair of blocks is a group of its own, so no task holds or compares
all lines of a word. How many blocks is told by sums over buckets of words.

A line that many earlier ones may match is first checked against the ``FIRST`` earliest of
them at each word; only if none of these matches, against all at the words that have more.
Into that second round a line enters only the words at which such a line of a like size is met.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.tables import fresh, written

BUCKET_BITS = 18
SLICES = 64
# Bytes of text whose lines are worked on at once; a longer line is worked on whole.
CHUNK_BYTES = 1 << 19
# Runs of so many lines are compared all at once, shift by shift.
SHORT_RUN = 64
FIRST = 4
# Lines, or prefix words, that a task deals to groups at once.
HELD = 1 << 17
# Words of text whose lines meet in one group to be merged, and prefix words that meet in one to be paired.
GROUP_WORDS, GROUP_ENTRIES = 1 << 19, 1 << 16
# Lines of one word that meet in one group; more are dealt to pairs of blocks.
BLOCK = 4096
# Bits of the filter that says which lines to fetch for verification.
FILTER_BITS = 23
# Integers of parities by which pairs are sifted before their sets meet.
LANES = 8
# Lines of more words carry parities in twice as many places.
WIDE = 72
# Pairs of lines whose parities are compared at once.
TILE = 1 << 13
NO_ID = -(1 << 63)

# Words of more bytes are hashed one by one.
LONG_WORD = 64
# The bytes of a word in its last eight: the lowest come first.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A mix of all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of its line.

    A word's hash is taken from its bytes, eight at a time, of all words together.
    """
    data = data.lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    np.logical_or(raw - np.uint8(9) < 5, raw == 32, out=space[1:-1])
    # Words begin and end by turns.
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    length = ends - starts
    eights = np.frombuffer(data + bytes(16 - len(data) % 8), dtype="<u8")
    hashes = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    own, at, left = None, starts, length
    while len(at):
        low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        part = (eights[low] >> shift) | ((eights[low + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        part &= _MASKS[np.minimum(left, 8)]
        if own is None:
            hashes = _scramble(hashes ^ part)
        else:
            hashes[own] = _scramble(hashes[own] ^ part)
        more = np.flatnonzero((left > 8) & (left <= LONG_WORD) if own is None else left > 8)
        own, at, left = more if own is None else own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest()
        hashes[k] = int.from_bytes(digest, "little")
    before = np.searchsorted(starts, np.flatnonzero(raw == 10))
    return hashes, np.repeat(np.arange(len(before) + 1), np.diff(np.r_[0, before, len(starts)]))


class LineSets:
    """The word sets of the lines of a piece of text, in order of rarity.

    ``line``: the number of each line that has words; ``start``: where its words
    begin in ``words``; ``size``: how many they are.
    """

    def __init__(self, data: bytes, ranks: np.ndarray):
        hashes, line = word_hashes(data)
        rank = ranks[hashes >> np.uint64(64 - BUCKET_BITS)]
        packed = (
            (line.astype(np.uint64) << np.uint64(44))
            | (rank.astype(np.uint64) << np.uint64(36))
            | (hashes >> np.uint64(28))
        )
        order = np.argsort(packed)
        near = packed[order]
        if len(line) and (line[-1] >> 20 or (
            (near[1:] == near[:-1]) & (hashes[order][1:] != hashes[order][:-1])
        ).any()):
            # More lines than the packed key has room for, or two words that it does not tell apart.
            order = np.lexsort((hashes, rank, line))
        hashes, line = hashes[order], line[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.words, line = hashes[new], line[new]
        self.start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, dtype=np.int64)
        self.line = line[self.start]
        self.size = np.diff(np.r_[self.start, len(line)])

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line two independent hashes of the set, and the parities of its words in 64 places."""
        if not len(self.start):
            return (np.zeros(0, dtype=np.uint64),) * 3
        one = np.add.reduceat(_scramble(self.words ^ np.uint64(0x1234567)), self.start)
        two = np.add.reduceat(_scramble(self.words + np.uint64(0x9E3779B97F4A7C15)), self.start)
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (self.words & np.uint64(63)), self.start)
        return one, two, bits

    def wide(self) -> np.ndarray:
        """For each line of more than ``WIDE`` words the parities of half of them in 64 places, else none.

        Those of the other half differ from ``bits`` of ``digests`` by these.
        """
        out = np.zeros(len(self.start), dtype=np.uint64)
        long = np.flatnonzero(self.size > WIDE)
        if len(long):
            own = self.words[np.repeat(self.size > WIDE, self.size)]
            ends = np.cumsum(self.size[long])
            half = np.where(own >> np.uint64(6) & np.uint64(1) == 1, np.uint64(1) << (own & np.uint64(63)), np.uint64(0))
            out[long] = np.bitwise_xor.reduceat(half, ends - self.size[long])
        return out.view(np.int64)

    def parities(self) -> np.ndarray:
        """For each line the parities of its words in ``LANES`` times 64 places, a row of integers."""
        out = np.zeros((len(self.start), LANES), dtype=np.uint64)
        if len(self.start):
            lane, bit = (self.words >> np.uint64(6)) % np.uint64(LANES), np.uint64(1) << (self.words & np.uint64(63))
            for k in range(LANES):
                out[:, k] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), self.start)
        return out.view(np.int64)


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Pieces of about ``CHUNK_BYTES``, with document and place (part and number) of each line."""
    pieces: list[bytes] = []
    docs: list[np.ndarray] = []
    ats: list[np.ndarray] = []
    size = 0

    def piece():
        return b"\n".join(pieces), np.concatenate(docs), np.concatenate(ats)

    for doc, part, text in zip(batch["doc"].tolist(), batch["part"].tolist(), batch["text"]):
        rest, number = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, 0
        while True:
            cut = rest.find(b"\n", CHUNK_BYTES) if len(rest) > CHUNK_BYTES else -1
            head = rest if cut < 0 else rest[:cut]
            n = head.count(b"\n") + 1
            pieces.append(head)
            docs.append(np.full(n, doc, dtype=np.int64))
            ats.append((np.int64(part) << np.int64(32)) | np.arange(number, number + n, dtype=np.int64))
            number, size = number + n, size + len(head)
            if size >= CHUNK_BYTES:
                yield piece()
                pieces, docs, ats, size = [], [], [], 0
            if cut < 0:
                break
            rest = rest[cut + 1 :]
    if pieces:
        yield piece()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """The documents, and what tells their rows apart: two numbers, in the order of the corpus.

    They are the id and 31 bits of the text's hash. Where two texts of one id, or two without
    one, have the same bits, which another hash tells, the pairs of id and text are
    sorted and numbered in a table of their own, and the number is joined to each row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, one, two = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text), F.xxhash64(F.lit(7), text)
    part = one.bitwiseAND(F.lit(0x7FFFFFFF))
    keys = docs.select(doc.alias("doc"), part.alias("part"), one.alias("one"), two.alias("two"))
    clashes = keys.groupBy("doc", "part").agg(
        F.min("one").alias("a"), F.max("one").alias("b"), F.min("two").alias("c"), F.max("two").alias("d")
    ).filter("a <> b OR c <> d")
    if clashes.isEmpty():
        return docs, doc, part
    number, key, first, second = fresh(docs, "__number", "__id", "__one", "__two")
    ordered = keys.select("doc", "part", "one", "two").distinct().orderBy("doc", "part", "one", "two")
    # The number of the range and the place in it; written, so that it stays the same.
    numbers = written(ordered.select("doc", "one", "two", F.monotonically_increasing_id().alias("n"))).select(
        F.col("doc").alias(key), F.col("one").alias(first), F.col("two").alias(second), F.col("n").alias(number)
    )
    joined = docs.join(numbers, (doc == F.col(key)) & (one == F.col(first)) & (two == F.col(second)))
    return written(joined.drop(key, first, second)), F.col(number), F.lit(0).cast("long")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, part, text`` of all rows."""
    return _numbered(*_keyed(docs, id_col, text_col), text_col)


def _numbered(docs: DataFrame, doc: Column, part: Column, text_col: str) -> DataFrame:
    # As bytes, which workers take as they are.
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(doc.alias("doc"), part.alias("part"), text.alias("text"))


def word_ranks(rows: DataFrame) -> np.ndarray:
    """For each bucket of word hashes, how often its words occur, as a logarithm in a byte."""
    def words(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        for data, _, _ in _chunks(batch):
            yield word_hashes(data)[0]

    # Only the texts are read, without the hashes that tell rows apart.
    texts = rows.select(F.lit(0).alias("doc"), F.lit(0).alias("part"), "text")
    return np.minimum(255, np.round(6 * np.log2(_bucket_counts(texts, words) + 1))).astype(np.uint8)


def _bucket_counts(rows: DataFrame, words: Callable[[pd.DataFrame], Iterator[np.ndarray]]) -> np.ndarray:
    """How many words of the batches of ``rows`` fall in each bucket of word hashes."""
    size = 1 << BUCKET_BITS
    per_slice = size // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held = np.zeros(size, dtype=np.int64), []

        def counted() -> np.ndarray:
            found = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
            return np.bincount(found, minlength=size)

        for batch in batches:
            for hashes in words(batch):
                held.append((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                if sum(map(len, held)) > 2 * size:
                    counts += counted()
                    held = []
        counts += counted()
        parts = counts.reshape(SLICES, per_slice)
        yield pd.DataFrame({"slice": np.arange(SLICES), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(per_slice, dtype=np.int64)
        for raw in frame["counts"]:
            total += np.frombuffer(zlib.decompress(raw), dtype=np.int64)
        return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    counted = rows.mapInPandas(count, "slice int, counts binary")
    # 2**18 counts for any corpus.
    found = counted.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    totals = np.zeros((SLICES, per_slice), dtype=np.int64)
    for row in found:
        totals[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return totals.ravel()


def prefix_length(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


# What a line takes to where it meets those of its set, beside the words of its prefix, ``k`` of them.
LINE = np.dtype([(c, "<i8") for c in ("one", "two", "doc", "at", "size", "bits", "wide", "k")])
PLACE = np.dtype([("doc", "<i8"), ("at", "<i8")])
MERGED_SCHEMA = "doc long, at long, size long, bits long, wide long, tokens binary"


def _dealt(group: np.ndarray, records: np.ndarray, words: np.ndarray | None = None) -> pd.DataFrame:
    """A row per group that ``records`` go to, with these as bytes; ``words``, of lines, go with them."""
    order = np.argsort(group, kind="stable")
    group, records = group[order], records[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    ends = np.r_[cuts[1:], len(group)] if len(group) else cuts
    out = {"group": group[cuts], "rows": [records[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())]}
    if words is not None:
        k = records["k"]
        upto = np.r_[0, np.cumsum(k)]
        start = np.empty(len(k), dtype=np.int64)
        start[order] = k
        start = (np.cumsum(start) - start)[order]
        words = words[_spans(start, k)]
        out["words"] = [words[a:b].tobytes() for a, b in zip(upto[cuts].tolist(), upto[ends].tolist())]
    return pd.DataFrame(out)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of them, one span after the other."""
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - n), n)


def _first_of_equal(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the earliest of their sets, one each, and which have an earlier one.

    A row that repeats id and text is merged with itself; its lines are in neither.
    """
    one, two, doc, at = (np.ascontiguousarray(lines[c]) for c in ("one", "two", "doc", "at"))
    order = np.lexsort((at, doc, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = np.empty(len(order), dtype=np.int64)
    head[order] = order[new][np.cumsum(new) - 1]
    return np.flatnonzero(head == np.arange(len(head))), np.flatnonzero((doc != doc[head]) | (at != at[head]))


def _merged(rows: DataFrame, ranks: np.ndarray, threshold: float) -> DataFrame:
    """A row per distinct set, and one without words for each line with an earlier one of an equal set.

    That of a set has its earliest line, size, parities and prefix words; equal sets have equal
    prefixes. ``at`` is the part and the number of the line. Lines are merged by ``HELD`` of a task
    at once, and then where all of one hash meet, dealt in groups of about ``GROUP_WORDS`` words of text.
    """
    groups = 1 + int(np.exp2(ranks / 6).sum()) // GROUP_WORDS

    def merged(lines: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, later = _first_of_equal(lines)
        kept, k = lines[first], lines["k"]
        gone = np.empty(len(later), dtype=PLACE)
        gone["doc"], gone["at"] = lines["doc"][later], lines["at"][later]
        return kept, words[_spans((np.cumsum(k) - k)[first], kept["k"])], gone

    def deal(lines: list[np.ndarray], words: list[np.ndarray]) -> pd.DataFrame:
        kept, own, gone = merged(np.concatenate(lines), np.concatenate(words))
        there = _dealt((kept["one"].view(np.uint64) % np.uint64(groups)).astype(np.int64), kept, own)
        aside = _dealt((_mixed(gone["doc"], gone["at"]) % np.uint64(groups)).astype(np.int64), gone)
        sent = pd.concat([there.assign(gone=b""), aside.rename(columns={"rows": "gone"}).assign(rows=b"", words=b"")])
        return sent[["group", "rows", "words", "gone"]]

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, words = [], []
        for batch in batches:
            for data, docs, ats in _chunks(batch):
                sets = LineSets(data, ranks)
                one, two, bits = sets.digests()
                own = np.empty(len(sets.line), dtype=LINE)
                own["doc"], own["at"], own["size"], own["wide"] = docs[sets.line], ats[sets.line], sets.size, sets.wide()
                own["one"], own["two"], own["bits"] = one.view(np.int64), two.view(np.int64), bits.view(np.int64)
                own["k"] = prefix_length(sets.size, threshold)
                lines.append(own)
                words.append(sets.words[_spans(sets.start, own["k"])].view(np.int64))
                if sum(map(len, lines)) >= HELD:
                    yield deal(lines, words)
                    lines, words = [], []
        if lines:
            yield deal(lines, words)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        lines = np.frombuffer(b"".join(frame["rows"]), dtype=LINE)
        kept, words, gone = merged(lines, np.frombuffer(b"".join(frame["words"]), dtype=np.int64))
        gone = np.r_[gone, np.frombuffer(b"".join(frame["gone"]), dtype=PLACE)]
        upto = np.r_[0, 8 * np.cumsum(kept["k"])].tolist()
        whole = words.tobytes()
        none = np.zeros(len(gone), dtype=np.int64)
        out = {c: np.r_[kept[c], gone[c] if c in PLACE.names else none] for c in ("doc", "at", "size", "bits", "wide")}
        return pd.DataFrame({**out, "tokens": [whole[a:b] for a, b in zip(upto[:-1], upto[1:])] + [None] * len(gone)})

    sent = rows.mapInPandas(enter, "group long, rows binary, words binary, gone binary")
    return sent.groupBy("group").applyInPandas(meet, MERGED_SCHEMA)


def _firsts(rows: DataFrame, ranks: np.ndarray, threshold: float) -> DataFrame:
    """A row per distinct set: its earliest line, size, parities and prefix words."""
    return _merged(rows, ranks, threshold).filter("tokens IS NOT NULL")


def _tokens(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The prefix words of all lines, one line after the other, and how many each has."""
    return np.frombuffer(b"".join(batch["tokens"]), dtype=np.int64), batch["tokens"].map(len).to_numpy() // 8


PREFIX_SCHEMA = (
    "token long, left int, right int, doc long, at long, shape long, lead long, bits long, wide long, every boolean"
)


def _prefix_counts(firsts: DataFrame) -> np.ndarray:
    """For each bucket of words, in how many prefixes its words are."""

    def words(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        if len(batch):
            yield _tokens(batch)[0].view(np.uint64)

    return _bucket_counts(firsts.select("tokens"), words)


def _blocks(firsts: DataFrame) -> np.ndarray:
    """For each bucket of words, in how many blocks the lines of one of its words are dealt."""
    return _block_counts(_prefix_counts(firsts))


def _block_counts(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-counts // BLOCK))


def _size_class(size: np.ndarray, threshold: float) -> np.ndarray:
    """Sizes of lines that match are in one class or in adjacent ones, at any threshold above zero."""
    return np.floor(np.log(size) / -np.log(threshold) + 1e-9).astype(np.int64) if threshold < 1 else size


def _met(token: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    """The bit of a word among lines of a size class."""
    return _bit(token, size_class).astype(np.int64)


def _met_filter(marked: DataFrame, threshold: float) -> bytes:
    """A bitmap of fixed size that knows the words of ``again`` with the size classes that may match there."""

    def words(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        token = np.concatenate(batch["again"].tolist()).astype(np.int64)
        near = np.repeat(_size_class(batch["size"].to_numpy(), threshold), batch["again"].map(len).to_numpy())
        return np.tile(token, 3), np.r_[near - 1, near, near + 1]

    return _bitmap(marked.filter("size(again) > 0").select("size", "again"), words)


def _entries(batch: pd.DataFrame, blocks: np.ndarray, wanted: np.ndarray | None, threshold: float) -> Iterator[dict]:
    """What the lines of a batch enter at each prefix word and pair of blocks, see ``_prefixes``."""
    token, k = _tokens(batch)
    row = np.repeat(np.arange(len(batch)), k)
    begin = np.cumsum(k) - k
    place, leads = np.arange(len(row)) - begin[row], token[begin]
    if wanted is not None:
        enters = np.flatnonzero(wanted[_met(token, _size_class(batch["size"].to_numpy(), threshold)[row])])
        if not len(enters):
            return
        token, row, place = token[enters], row[enters], place[enters]
    if "every" in batch:
        every = batch["every"].to_numpy(dtype=bool)[row]
    else:
        again = batch["again"].map(len).to_numpy()
        marks = _mixed(np.repeat(np.arange(len(batch)), again), np.concatenate(batch["again"].tolist()).astype(np.int64))
        every = np.isin(_mixed(row, token), marks)
    doc, at = batch["doc"].to_numpy(), batch["at"].to_numpy()
    size, bits, wide = batch["size"].to_numpy(), batch["bits"].to_numpy(), batch["wide"].to_numpy()
    many = blocks[(token.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    own = _block(doc[row], at[row], many)
    # Lines are short rows; a batch of hot words is given out in pieces.
    upto = np.cumsum(many)
    cuts = np.r_[0, np.flatnonzero(np.diff(upto >> 18)) + 1, len(row)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        each, other = slice(a, b), 0
        if (many[a:b] > 1).any():
            each = np.repeat(np.arange(a, b), many[a:b])
            other = np.arange(len(each)) - np.repeat(upto[a:b] - many[a:b] - (upto[a] - many[a]), many[a:b])
        r = row[each]
        yield {
            "token": token[each],
            "left": np.minimum(own[each], other).astype(np.int32),
            "right": np.maximum(own[each], other).astype(np.int32),
            "doc": doc[r],
            "at": at[r],
            "shape": (size[r] << 32) | place[each],
            "lead": leads[r],
            "bits": bits[r],
            "wide": wide[r],
            "every": every[each],
        }


def _prefixes(firsts: DataFrame, blocks: np.ndarray) -> DataFrame:
    """A row per prefix word of each line and pair of blocks that it is in; ``firsts`` has ``every``.

    ``shape`` is the size of the set and the place of the word, ``lead`` the rarest word
    of the line, ``bits`` and ``wide`` the parities of the words, ``left`` and ``right`` the blocks.
    """

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from map(pd.DataFrame, _entries(batch, blocks, None, 1.0))

    return firsts.select("doc", "at", "size", "bits", "wide", "tokens", "every").mapInPandas(enter, PREFIX_SCHEMA)


# A row of ``_prefixes``, a line that gets all its partners with the lowest ``shape`` added; what is mostly zero lies together.
ENTRY = np.dtype(
    [(c, "<i8") for c in ("token", "lead", "bits", "at", "doc", "shape")]
    + [("left", "<i4"), ("right", "<i4"), ("wide", "<i8")]
)
EVERY = np.int64(-(1 << 63))


def _dealt_entries(
    lines: DataFrame, blocks: np.ndarray, groups: int, threshold: float, wanted: bytes | None = None
) -> DataFrame:
    """The rows of ``_prefixes`` as bytes, dealt to groups by word and pair of blocks.

    With ``wanted``, a filter of words and size classes, only what it lets through enters. Where ``lines``
    has ``again`` and not ``every``, these are the words at which a line gets all its partners.
    """

    def deal(held: list[np.ndarray]) -> pd.DataFrame:
        entries = np.concatenate(held)
        pair = (entries["left"].astype(np.int64) << 32) | entries["right"]
        key = _mixed(np.ascontiguousarray(entries["token"]), pair) >> np.uint64(20)
        return _dealt((key % np.uint64(groups)).astype(np.int64), entries)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passes = None if wanted is None else np.unpackbits(np.frombuffer(wanted, dtype=np.uint8)).view(bool)
        held = []
        for batch in batches:
            if not len(batch):
                continue
            for found in _entries(batch, blocks, passes, threshold):
                entries = np.empty(len(found["token"]), dtype=ENTRY)
                for c in ENTRY.names:
                    entries[c] = found[c]
                entries["shape"][found["every"]] |= EVERY
                held.append(entries)
                if sum(map(len, held)) >= 2 * HELD:
                    yield deal(held)
                    held = []
        if held:
            yield deal(held)

    marks = "again" if "again" in lines.columns else "every"
    return lines.select("doc", "at", "size", "bits", "wide", "tokens", marks).mapInPandas(enter, "group long, rows binary")


def _allowed(shape_a, shape_b, lead_a, lead_b, bits_a, bits_b, threshold: float, wide_a=None, wide_b=None):
    """Length, positional and parity filters on pairs of lines with a word in common.

    Lines with one rarest word meet there, and not once more at their other words.
    """
    mask = np.int64(0xFFFFFFFF)
    na, nb, i, j = shape_a >> 32, shape_b >> 32, shape_a & mask, shape_b & mask
    needed = threshold / (1 + threshold) * (na + nb) - 1e-6
    ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-6
    ok &= (lead_a != lead_b) | (i + j == 0)
    ok &= np.minimum(i, j) + np.minimum(na - i, nb - j) >= needed
    # Unsigned, or the count would be that of the absolute value.
    differ = (bits_a ^ bits_b).view(np.uint64)
    if wide_a is None:
        apart = np.bitwise_count(differ)
    else:
        half = np.where((na > WIDE) & (nb > WIDE), wide_a ^ wide_b, 0).view(np.uint64)
        apart = np.bitwise_count(half) + np.bitwise_count(differ ^ half)
    return ok & (na + nb - apart >= 2 * needed)


# ``more``: the line has further partners at the word ``token``; one of its pairs says so.
PAIR_SCHEMA = "a_doc long, a_at long, doc long, at long, more boolean, token long"


def _pairs(doc, at, a, b, more=False, token=0) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "a_doc": doc[a], "a_at": at[a], "doc": doc[b], "at": at[b],
            "more": np.broadcast_to(more, len(a)), "token": np.where(np.broadcast_to(more, len(a)), token, np.int64(0)),
        }
    )


def _near(shape, bits, every, threshold, again=False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an earlier and a later line of a long run that parities let through; a later line has all of its in one piece.

    Lines are compared in the order of their sizes with those whose sizes may match, in tiles
    of fixed size. With ``again`` only lines that ``every`` marks ask.
    """
    size, odd, bits = shape >> 32, _odd(shape, threshold), bits.view(np.uint64)
    by_size = np.argsort(size, kind="stable")
    sorted_size = size[by_size]
    asked = by_size[every[by_size]] if again else by_size
    start = 0
    while start < len(asked):
        low = np.searchsorted(sorted_size, threshold * size[asked[start]] - 1e-6)
        stop = min(len(asked), start + max(1, TILE // max(1, len(size) - low)))
        high = np.searchsorted(sorted_size, size[asked[stop - 1]] / threshold + 1e-6, side="right")
        rows, left = asked[start:stop], by_size[low:high]
        start = stop
        # First the same bound for all of the tile, that of its longest lines.
        apart = np.bitwise_count(bits[left][None] ^ bits[rows][:, None])
        r, a = np.divmod(np.flatnonzero(apart <= min(64, int(odd[rows[-1]] + odd[left[-1]]))), len(left))
        i, j = left[a], rows[r]
        ok = (i < j) & (odd[i] + odd[j] >= apart[r, a])
        yield i[ok], j[ok]


def _settled(doc, at, shape, lead, bits, every, threshold, block, wide, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that all filters let through: the ``FIRST`` earliest of each line or every one, and what ``more`` says.

    With ``block``, pairs of lines of two blocks, where it is not below zero.
    """
    wides = () if wide is None else (wide[i], wide[j])
    ok = _allowed(shape[i], shape[j], lead[i], lead[j], bits[i], bits[j], threshold, *wides)
    ok &= (doc[i] != doc[j]) | (at[i] != at[j])
    if block is not None:
        ok &= (block[i] != block[j]) | (block[i] < 0)
    i, j = i[ok], j[ok]
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    kept, more = _earliest(j, every[j])
    return i[kept], j[kept], more


def _run_pairs(
    doc, at, shape, lead, bits, every, threshold, block=None, token=0, again=False, wide=None
) -> Iterator[pd.DataFrame]:
    """Pairs in a long run of one word, sorted by place in the corpus: the ``FIRST`` earliest of each line.

    ``every`` marks the lines that get all of theirs, and with ``again`` no others are asked for.
    """
    for i, j in _near(shape, bits, every, threshold, again):
        i, j, more = _settled(doc, at, shape, lead, bits, every, threshold, block, wide, i, j)
        if len(i):
            yield _pairs(doc, at, i, j, more, token)


def _odd(shape: np.ndarray, threshold: float) -> np.ndarray:
    """Of two lines that match, the sum of these is at least the number of words that only one has."""
    return (shape >> 32) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _earliest(line: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs stay, of each line the ``FIRST`` or every one, and which of those say that there are more.

    The pairs are sorted by ``line``.
    """
    first = np.searchsorted(line, line)
    nth, many = np.arange(len(line)) - first, np.searchsorted(line, line, side="right") - first > FIRST
    kept = np.flatnonzero((nth < FIRST) | every)
    return kept, (many & ~every & (nth == 0))[kept]


def _bucket_pairs(frame: pd.DataFrame, threshold: float, blocks: np.ndarray, again: bool = False) -> pd.DataFrame:
    """Pairs within each run of one word and pair of blocks."""
    token, left, right, doc, at, shape, lead, bits, wide = (
        frame[c].to_numpy() for c in ("token", "left", "right", "doc", "at", "shape", "lead", "bits", "wide")
    )
    every = frame["every"].to_numpy(dtype=bool)
    n = len(token)
    found: list[tuple[np.ndarray, ...]] = []
    if n > 1:
        many = blocks[(token.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        # Lines of one block meet in its pair with itself.
        block = np.where(left == right, -1, _block(doc, at, many))
        new = (token[1:] != token[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(np.r_[True, new])
        length = np.diff(np.r_[first, n])
        some = np.repeat((length > 1) & (length <= SHORT_RUN), length)
        short = np.flatnonzero(some)
        of = np.repeat(np.arange(len(length)), length)[short]
        odd, near, held = _odd(shape, threshold), [], 0
        for shift in range(1, min(SHORT_RUN, len(short))):
            at_left = np.flatnonzero(of[shift:] == of[:-shift])
            if not len(at_left):
                break
            i, j = short[at_left], short[at_left + shift]
            ok = odd[i] + odd[j] >= np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64))
            if again:
                ok &= every[j]
            near.append((i[ok], j[ok]))

        def settle() -> None:
            i, j = (np.concatenate(side) for side in zip(*near))
            found.append(_settled(doc, at, shape, lead, bits, every, threshold, block, wide, i, j))

        for run in np.flatnonzero(length > SHORT_RUN):
            start, part = first[run], slice(first[run], first[run] + length[run])
            for i, j in _near(shape[part], bits[part], every[part], threshold, again):
                near.append((i + start, j + start))
                held += len(i)
                if held > HELD:
                    settle()
                    near, held = [], 0
        if near:
            settle()
    none = np.zeros(0, dtype=np.int64)
    i, j, more = (np.concatenate(side) for side in zip(*found)) if found else (none, none, none.astype(bool))
    return _pairs(doc, at, i, j, more, token[j])


def _candidates(dealt: DataFrame, threshold: float, blocks: np.ndarray, again: bool = False) -> DataFrame:
    """Pairs of an earlier and a later line that the filters let through; with ``again`` of lines that get every one.

    ``dealt`` is as from ``_dealt_entries``.
    """

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        entries = np.frombuffer(b"".join(frame["rows"]), dtype=ENTRY)
        token = np.ascontiguousarray(entries["token"])
        order = np.argsort(token)
        # Words of one line only.
        same = token[order][1:] == token[order][:-1]
        entries = entries[order[np.r_[same, False] | np.r_[False, same]]]
        columns = {c: np.ascontiguousarray(entries[c]) for c in ENTRY.names}
        keys = [columns[c] for c in ("at", "doc", "right", "left", "token") if c not in ("left", "right") or columns[c].any()]
        order = np.lexsort(keys)
        met = pd.DataFrame({c: v[order] for c, v in columns.items()})
        every = met["shape"] < 0
        return _bucket_pairs(met.assign(every=every, shape=met["shape"] & ~EVERY), threshold, blocks, again)

    return dealt.groupBy("group").applyInPandas(meet, PAIR_SCHEMA)


def _block(doc: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The block of each line at a word that is dealt in ``many`` of them."""
    return ((_mixed(doc, at) >> np.uint64(20)) % many.astype(np.uint64)).astype(np.int64)


def _mixed(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the place of each line."""
    mixed = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _bit(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mixed(doc, at) >> np.uint64(64 - FILTER_BITS)


def _line_filter(lines: DataFrame) -> bytes:
    """A bitmap of fixed size that knows all lines of ``doc, at``, and their documents; others may pass it too."""

    def keys(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        doc, at = batch["doc"].to_numpy(), batch["at"].to_numpy()
        return np.r_[doc, doc], np.r_[at, ~(at >> 32)]

    return _bitmap(lines.select("doc", "at"), keys)


def _bitmap(rows: DataFrame, keys: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A bitmap of fixed size of all pairs of numbers that the batches of ``rows`` have."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            if len(batch):
                bits[_bit(*keys(batch)).astype(np.int64)] = True
        parts = np.packbits(bits).reshape(SLICES, -1)
        yield pd.DataFrame({"slice": np.arange(SLICES), "bits": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << FILTER_BITS) // 8 // SLICES, dtype=np.uint8)
        for raw in frame["bits"]:
            total |= np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
        return pd.DataFrame({"slice": [key[0]], "bits": [total.tobytes()]})

    marked = rows.mapInPandas(mark, "slice int, bits binary").groupBy("slice")
    found = {r["slice"]: r["bits"] for r in marked.applyInPandas(join, "slice int, bits binary").collect()}
    empty = bytes((1 << FILTER_BITS) // 8 // SLICES)
    return b"".join(found.get(k, empty) for k in range(SLICES))


def _sets(rows: DataFrame, wanted: bytes) -> DataFrame:
    """``doc, at, words, odd`` of the lines that the filter lets through."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(wanted, dtype=np.uint8)).view(bool)
        plain = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
        for batch in batches:
            batch = batch[bits[_bit(batch["doc"].to_numpy(), ~batch["part"].to_numpy()).astype(np.int64)]]
            for data, docs, ats in _chunks(batch):
                hit = bits[_bit(docs, ats).astype(np.int64)]
                if not hit.any():
                    continue
                lines = data.split(b"\n")
                chosen = np.flatnonzero(hit)
                sets = LineSets(b"\n".join(lines[k] for k in chosen), plain)
                own = chosen[sets.line]
                words = [sets.words[a : a + n].view(np.int64) for a, n in zip(sets.start, sets.size)]
                yield pd.DataFrame({"doc": docs[own], "at": ats[own], "words": words, "odd": list(sets.parities())})

    # Rows that repeat an id and a text are one.
    fetched = rows.mapInPandas(fetch, "doc long, at long, words array<long>, odd array<long>")
    return fetched.dropDuplicates(["doc", "at"])


def _verified(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``doc, at`` of the later lines of pairs that match.

    The sets are fetched once. Pairs are sifted by the parities of their words: a place where
    two sets differ in parity has a word that only one of them has, so the words in common are
    at most what that leaves, and no match is lost. Each line that is left is compared with
    its earliest partner first, which settles nearly all; only the others meet the rest.
    """
    ends = pairs.select("doc", "at").unionByName(pairs.select(F.col("a_doc").alias("doc"), F.col("a_at").alias("at")))
    sets = written(_sets(rows, _line_filter(ends)))
    pairs = written(_sifted(pairs, sets, threshold))
    earliest = pairs.groupBy("doc", "at").agg(F.min(F.struct("a_doc", "a_at")).alias("a")).select("doc", "at", "a.*")
    found = written(_matching(earliest, sets, threshold))
    others = pairs.join(found, ["doc", "at"], "left_anti").select("a_doc", "a_at", "doc", "at")
    return found.unionByName(written(_matching(others, sets, threshold)))


def _sifted(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that may match by the parities of their sets."""
    narrow = sets.select("doc", "at", F.size("words").alias("n"), "odd")
    earlier = narrow.select(*(F.col(c).alias(f"_a_{c}") for c in narrow.columns))
    later = narrow.select(*(F.col(c).alias(f"_b_{c}") for c in narrow.columns))
    both = pairs.join(later, (F.col("doc") == F.col("_b_doc")) & (F.col("at") == F.col("_b_at"))).join(
        earlier, (F.col("a_doc") == F.col("_a_doc")) & (F.col("a_at") == F.col("_a_at"))
    )
    apart = sum(F.bit_count(F.col("_a_odd")[k].bitwiseXOR(F.col("_b_odd")[k])) for k in range(LANES))
    whole = F.col("_a_n") + F.col("_b_n")
    return both.filter((whole - apart) / 2 >= whole * (threshold / (1 + threshold)) - 1e-6).select(
        "a_doc", "a_at", "doc", "at"
    )


def _matching(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``doc, at`` of the later lines of the pairs whose sets match."""
    earlier = sets.select(F.col("doc").alias("_a_doc"), F.col("at").alias("_a_at"), F.col("words").alias("_a"))
    later = sets.select(F.col("doc").alias("_b_doc"), F.col("at").alias("_b_at"), F.col("words").alias("_b"))
    both = pairs.join(later, (F.col("doc") == F.col("_b_doc")) & (F.col("at") == F.col("_b_at"))).join(
        earlier, (F.col("a_doc") == F.col("_a_doc")) & (F.col("a_at") == F.col("_a_at"))
    )
    common = F.size(F.array_intersect("_a", "_b")).cast("double")
    whole = F.size("_a") + F.size("_b")
    return both.filter(common >= whole * (threshold / (1 + threshold)) - 1e-6).select("doc", "at").distinct()


def repeated_lines(rows: DataFrame, threshold: float) -> DataFrame:
    """``doc, at`` of every line to be removed, each once."""
    merged = written(_merged(rows, word_ranks(rows), threshold))
    firsts, sure = merged.filter("tokens IS NOT NULL"), merged.filter("tokens IS NULL").select("doc", "at")
    counts = _prefix_counts(firsts)
    blocks = _block_counts(counts)
    groups = 1 + int((counts * blocks).sum()) // GROUP_ENTRIES
    entered = _dealt_entries(firsts.withColumn("every", F.lit(False)), blocks, groups, threshold)
    pairs = written(_candidates(entered, threshold, blocks).distinct())
    found = written(_verified(rows, pairs.select("a_doc", "a_at", "doc", "at").distinct(), threshold))
    # The words at which a line has partners that it was not checked against.
    rest = written(
        pairs.filter("more").join(found, ["doc", "at"], "left_anti").groupBy("doc", "at").agg(
            F.collect_set("token").alias("again")
        )
    )
    if not rest.isEmpty():
        named = rest.select(F.col("doc").alias("_d"), F.col("at").alias("_l"), "again")
        marked = written(
            firsts.join(named, (F.col("doc") == F.col("_d")) & (F.col("at") == F.col("_l"))).select(
                "doc", "at", "size", "bits", "wide", "tokens", "again"
            )
        )
        # A line of the rest enters twice, to ask and to be met; a pair of it twice is made one.
        wanted = _met_filter(marked, threshold)
        entered = _dealt_entries(firsts.withColumn("every", F.lit(False)), blocks, groups, threshold, wanted).unionByName(
            _dealt_entries(marked, blocks, groups, threshold, wanted)
        )
        of_rest = written(
            _candidates(entered, threshold, blocks, True).select("a_doc", "a_at", "doc", "at").distinct()
        )
        found = found.unionByName(_verified(rows, of_rest, threshold))
    return written(sure.unionByName(found).distinct())


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and ``n_lines``, ``n_removed``.

    Null and empty texts stay as they are, with one line that is not compared. Rows without an
    id come first in the order. Rows that repeat both id and text are one document and
    keep the same lines. Very long texts are compared like others. An empty table
    gives an empty result. The two new columns replace columns of those names; any other extra
    column is passed through.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs, key, within = _keyed(docs, id_col, text_col)
    rows = _numbered(docs, key, within, text_col)
    gone = repeated_lines(rows, threshold)
    numbers, doc, part = fresh(docs, "__gone", "__doc", "__part")
    lists = gone.groupBy(F.col("doc").alias(doc), F.shiftright("at", 32).alias(part)).agg(
        F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias(numbers)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The lists of a partition are small; the texts need no sort.
    joined = docs.join(lists.hint("shuffle_hash"), (key == F.col(doc)) & (within == F.col(part)), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, numbered: pd.Series) -> pd.Series:
        out = []
        for whole, gone in zip(texts, numbered):
            drop = set(gone.tolist())
            out.append("\n".join(line for k, line in enumerate(whole.split("\n")) if k not in drop))
        return pd.Series(out, dtype=object)

    changed = F.col(numbers).isNotNull()
    kept = F.when(changed, without(F.when(changed, text).otherwise(""), F.coalesce(numbers, F.array().cast("array<int>")))).otherwise(
        F.col(text_col)
    )
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in own],
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_removed"),
    )
