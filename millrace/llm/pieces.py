"""SentencePiece encoding and decoding for merge-type vocabularies.

A normalized text is cut into symbols, one for each character. An agenda holds the adjacent
pairs whose joined text is a piece, the best score first, of equal ones the leftmost.
The pair on top becomes one symbol, and the pairs it makes with its neighbours enter
the agenda; pairs that have lost a side meanwhile are passed over. What is left when the
agenda is empty are the pieces of the text.

If no piece has a blank mark behind another character, no merge reaches over the place
before a blank mark. A text is then worked on in units, blank marks and what follows
them, and units that come again are kept in a bounded memo.

Every text of every Arrow batch is checked against the ``sentencepiece`` library, which also
normalizes and decodes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType

from millrace.llm.tables import fresh
from millrace.llm.tokens import text_chunks, tokenizer_path

BLANK = "▁"
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

_CODECS: dict[str, "PieceCodec"] = {}


def codec(path: str) -> "PieceCodec":
    """One codec per Python worker, so that its memo outlives a batch."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


# Units up to this length are merged many at once, and kept.
_SHORT = 40
_NONE = np.iinfo(np.int32).max


class PieceCodec:
    """Encodes as the library does with a vocabulary of merges and no sampling."""

    def __init__(self, path: str, max_units: int = 800_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(model.get_piece_size())]
        self._ids = {model.id_to_piece(i): i for i, other in enumerate(special) if not other}
        # Lower is better, as a heap wants it.
        self._rank = {piece: -model.get_score(i) for piece, i in self._ids.items()}
        self._bytes = {}
        for i in range(len(special)):
            if model.is_byte(i):
                self._bytes[int(model.id_to_piece(i)[3:-1], 16)] = i
        self._unknown = model.unk_id()
        self._splits = all(BLANK not in piece.lstrip(BLANK) for piece in self._ids)
        # Characters that no piece has are never merged with others.
        inside = set().union(*self._ids)
        self._apart = re.compile(f"([^{re.escape(''.join(sorted(inside)))}]+)") if inside <= self._ids.keys() else None
        # Units by what follows their one blank mark, in two generations: when the younger is full, the
        # older is dropped, so units that come again stay and units seen once go.
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._max_units = max_units // 2
        self._pairs()
        self._begin = np.array([model.bos_id()], dtype="<u4").tobytes()
        self._end = np.array([model.eos_id()], dtype="<u4").tobytes()

    def merge(self, text: str) -> list[str]:
        """The symbols of a normalized text when no adjacent pair is a piece any more."""
        rank, size = self._rank, len(text)
        symbols: list[str] = list(text)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        agenda = []
        for i in range(size - 1):
            joined = symbols[i] + symbols[i + 1]
            if joined in rank:
                agenda.append((rank[joined], i, i + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            # A side that was merged meanwhile is longer now, or empty.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue
            symbols[left], symbols[right] = joined, ""
            far, near = after[right], before[left]
            after[left] = far
            if far < size:
                before[far] = left
                wider = joined + symbols[far]
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], left, far, wider))
            if near >= 0:
                wider = symbols[near] + joined
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], near, left, wider))
        return [symbol for symbol in symbols if symbol]

    def _pairs(self) -> None:
        """Tables for ``merge_many``: the sorted keys of all pairs of pieces that join to a piece, the joined
        piece of each, and the order of each piece's score."""
        self._size = max(self._ids.values(), default=0) + 1
        joins = {}
        for piece, joined in self._ids.items():
            for cut in range(1, len(piece)):
                left, right = self._ids.get(piece[:cut]), self._ids.get(piece[cut:])
                if left is not None and right is not None:
                    joins[left * self._size + right] = joined
        self._keys = np.array(sorted(joins), dtype=np.int64)
        self._joined = np.array([joins[key] for key in self._keys.tolist()], dtype=np.int32)
        self._order = np.full(self._size, _NONE, dtype=np.int32)
        pieces, places = list(self._ids), list(self._ids.values())
        if pieces:
            self._order[places] = np.unique([self._rank[p] for p in pieces], return_inverse=True)[1]

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols join to, and its place in the order of scores; ``_NONE`` for no piece."""
        if not len(self._keys):
            return np.zeros(len(left), dtype=np.int32), np.full(len(left), _NONE, dtype=np.int32)
        wanted = left.astype(np.int64) * self._size + right
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        joined = self._joined[at]
        return joined, np.where(self._keys[at] == wanted, self._order[joined], _NONE)

    def merge_many(self, texts: list[str]) -> list[bytes]:
        """The ids of many short normalized texts, whose characters are all pieces.

        Each text has its own agenda, a stretch of one array; in each round the pair on top
        of every agenda that is not empty is merged.
        """
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds, kind = np.unique(codes, return_inverse=True)
        symbols = np.array([self._ids[chr(code)] for code in kinds.tolist()], dtype=np.int32)[kind]
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        joined, order = np.zeros(len(symbols), dtype=np.int32), np.full(len(symbols), _NONE, dtype=np.int32)
        inner = np.flatnonzero(text[:-1] == text[1:])
        joined[inner], order[inner] = self._join(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            top = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.r_[starts, len(text)]))
            ended = top == _NONE
            if 2 * ended.sum() >= len(ended):
                done.append((text[ended], symbols[ended]))
                going = ~ended
                text, symbols, joined, order, top = text[going], symbols[going], joined[going], order[going], top[going]
                if not len(symbols):
                    break
            first = np.flatnonzero((order == top) & (top != _NONE))
            # The leftmost of equal ones.
            first = first[np.r_[True, text[first[1:]] != text[first[:-1]]]]
            symbols[first] = joined[first]
            kept = np.ones(len(symbols), dtype=bool)
            kept[first + 1] = False
            text, symbols, joined, order = text[kept], symbols[kept], joined[kept], order[kept]
            at = first - np.arange(len(first))
            changed = np.r_[at, at[at > 0] - 1]
            order[changed] = _NONE
            changed = changed[changed < len(text) - 1]
            changed = changed[text[changed] == text[changed + 1]]
            joined[changed], order[changed] = self._join(symbols[changed], symbols[changed + 1])
        if not done:
            return []
        text, symbols = (np.concatenate(parts) for parts in zip(*done))
        placed = np.argsort(text, kind="stable")
        raw = symbols[placed].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(text, minlength=len(texts))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, units: set[str]) -> None:
        """Put the units into the younger generation of the memo."""
        if len(self._memo) >= self._max_units:
            self._memo, self._older = {}, self._memo
        new = [unit for unit in units if unit not in self._memo]
        known = [(unit, self._older.get(unit)) for unit in new]
        self._memo.update((unit, ids) for unit, ids in known if ids is not None)
        new = [unit for unit, ids in known if ids is None]
        if self._apart is None:
            self._memo.update((unit, self._unit(BLANK + unit)) for unit in new)
            return
        plain, odd = [], []
        for unit in new:
            (odd if self._apart.search(unit) else plain).append(unit)
        # The others are stretches of pieces' characters, a blank mark first at least, and of other characters by turns.
        cut = [self._apart.split(BLANK + unit) for unit in odd]
        stretches = list({part for parts in cut for part in parts[::2] if part})
        coded = self.merge_many([BLANK + unit for unit in plain] + stretches)
        self._memo.update(zip(plain, coded))
        ids = dict(zip(stretches, coded[len(plain) :]))
        for unit, parts in zip(odd, cut):
            self._memo[unit] = b"".join(self._unlisted(part) if k % 2 else ids.get(part, b"") for k, part in enumerate(parts))

    def _unlisted(self, text: str) -> bytes:
        """The ids of characters that no piece has."""
        if not self._bytes:
            return array("I", [self._unknown] * len(text)).tobytes()
        return array("I", [self._bytes[b] for b in text.encode("utf-8", "surrogatepass")]).tobytes()

    def _unit(self, text: str) -> bytes:
        ids: list[int] = []
        for symbol in self.merge(text):
            known = self._ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self._bytes:
                ids += [self._bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self._unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        normalized = [self.library.normalize(text) for text in texts]
        if not self._splits or BLANK not in self._ids:
            return [self._framed(self._unit(text)) for text in normalized]
        cut = [text.split(BLANK) for text in normalized]
        self._learn({unit for units in cut for unit in units[1:] if 0 < len(unit) <= _SHORT})
        return [self._framed(self._whole(text, units)) for text, units in zip(normalized, cut)]

    def _whole(self, text: str, units: list[str]) -> bytes:
        if not units[0]:
            try:
                return b"".join(map(self._memo.__getitem__, units[1:]))
            except KeyError:
                pass
        # Blank marks that follow each other belong to one unit, none at the start to the first, and long units are not kept.
        parts = _UNITS.findall(text)
        return b"".join(self._memo.get(part[1:]) or self._unit(part) if part[0] == BLANK else self._unit(part) for part in parts)

    def _framed(self, ids: bytes) -> bytes:
        if not self._bytes:
            # Neighbouring unknown symbols are one.
            array = np.frombuffer(ids, dtype="<u4")
            unknown = array == self._unknown
            ids = array[~(unknown & np.r_[False, unknown[:-1]])].tobytes()
        return self._begin + ids + self._end

    def checked(self, texts: list[str]) -> list[tuple[bytes, list[int]]]:
        """The ids of each text, compared with those of the library."""
        coded = self.encode(texts)
        # One thread: the task's core is the only one it has.
        expected = self.library.encode(texts, add_bos=True, add_eos=True, enable_sampling=False, num_threads=1)
        for text, ids, wanted in zip(texts, coded, expected):
            if array("I", wanted).tobytes() != ids:
                raise ValueError(f"the agenda and the library differ on a text that begins with {text[:80]!r}")
        return list(zip(coded, expected))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_and_decode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None
) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: its ids as bytes (little-endian unsigned 32-bit
    integers, begin and end included) and the text that the library decodes from them.

    A null text is an empty one, which has begin and end alone; a null id stays null.
    Repeated rows are rows of their own, ties do not matter, other columns are not looked
    at, and an empty table gives an empty result. ``model`` is a file of the library on
    each machine. Raises if the vocabulary is not one of merges, or if the two ever differ.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), [text or "" for text in batch.column(1).to_pylist()]
            for chunk in text_chunks(texts, 1_000_000):
                coded = own.checked([texts[k] for k in chunk])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(chunk[0], len(chunk)),
                        pa.array([ids for ids, _ in coded], type=pa.binary()),
                        pa.array([own.decode(ids) for _, ids in coded], type=pa.string()),
                    ],
                    names=names,
                )

    plain = df.select(id_col, text_col)
    names = [id_col, *fresh(plain.select(id_col), "ids", "decoded")]
    schema = plain.select(id_col).schema.add(names[1], BinaryType()).add(names[2], StringType())
    return plain.mapInArrow(run, schema)
