"""Exact tokenization with a bounded memo of words.

A byte-level BPE encodes each pre-token on its own, and its pre-tokenizer always
cuts between a character that is no white space and a blank, so a text may be
cut there into units (a blank and what follows it) whose ids are simply put one
after the other. Texts repeat their words, so units met more than once are kept in a dict of bounded
size. Units at whose edges white space meets white space are not independent;
a text that has one is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[tuple[str, int], "WordMemoEncoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, max_units: int = 400_000) -> "WordMemoEncoder":
    """One encoder per Python worker, so that its memo outlives a batch."""
    key = (path, max_units)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordMemoEncoder(path, max_units)
    return _ENCODERS[key]


class WordMemoEncoder:
    """Encodes texts to ids as the ``tokenizers`` library does with ``add_special_tokens=False``."""

    def __init__(self, path: str, max_units: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_units = max_units
        self.after_blank: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary_size = max(vocabulary.values()) + 1
        self._opens_unit = np.zeros(self.vocabulary_size, dtype=bool)
        for token, token_id in vocabulary.items():
            self._opens_unit[token_id] = token.startswith("Ġ")

    def whole(self, text: str) -> bytes:
        """The ids of one text, without the memo."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Arrow cuts the texts and numbers their different units, so the memo is asked once
        for each of them; the ids are then gathered for all units at once.
        """
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        cuts = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        order = numbered.indices.to_numpy().astype(np.int64)
        units = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A text opens with a unit without a blank before it, which has other ids.
        opening, opens = np.unique(order[cuts[:-1]], return_inverse=True)
        order[cuts[:-1]] = len(units) + opens
        often = np.bincount(order, minlength=len(units) + len(opening)) > 1
        coded = self._known(self.after_blank, units, often[: len(units)], self._encode_units)
        starts = [units[k] for k in opening.tolist()]
        coded += self._known(self.at_start, starts, often[len(units) :], self._encode_first)

        lengths = np.fromiter((len(c) // 4 if c is not None else 0 for c in coded), dtype=np.int64, count=len(coded))
        flat = np.frombuffer(b"".join(c for c in coded if c), dtype="<u4")
        sizes = lengths[order]
        ends = np.cumsum(sizes)
        shift = (np.cumsum(lengths) - lengths)[order] - (ends - sizes)
        ids = flat[np.repeat(shift, sizes) + np.arange(len(shift) and int(ends[-1]))]
        upto = np.r_[0, ends][cuts].tolist()
        done = [ids[a:b].tobytes() for a, b in zip(upto, upto[1:])]
        odd = np.array([c is None for c in coded])[order]
        if odd.any():
            for k in np.unique(np.searchsorted(cuts, np.flatnonzero(odd), side="right") - 1).tolist():
                done[k] = self.whole(texts[k]) if texts[k] else b""
        return done

    def _known(
        self, memo: dict[str, bytes], units: list[str], often: np.ndarray, encode: Callable[[list[str]], dict[str, bytes]]
    ) -> list[bytes | None]:
        """The ids of each unit, None where it is not independent. Units met more than once enter the memo."""
        coded = list(map(memo.get, units))
        missing = [k for k, c in enumerate(coded) if c is None]
        found = encode([units[k] for k in missing])
        for k in missing:
            coded[k] = found.get(units[k])
        kept = [k for k in missing if often[k] and coded[k] is not None][: self.max_units]
        if len(memo) + len(kept) > self.max_units:
            memo.clear()
        memo.update((units[k], coded[k]) for k in kept)
        return coded

    def _encode_units(self, units: Iterable[str]) -> dict[str, bytes]:
        regular = [u for u in units if u and not u[0].isspace() and not u[-1].isspace()]
        found: dict[str, bytes] = {}
        for i in range(0, len(regular), 128):
            part = regular[i : i + 128]
            joined = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self._opens_unit[ids])
            if len(starts) != len(part) or starts[0] != 0:
                found.update({u: self.whole(" " + u) for u in part})
                continue
            raw, cuts = ids.tobytes(), (starts * 4).tolist() + [len(ids) * 4]
            found.update({u: raw[a:b] for u, a, b in zip(part, cuts, cuts[1:])})
        return found

    def _encode_first(self, units: Iterable[str]) -> dict[str, bytes]:
        regular = [u for u in units if not u or not u[-1].isspace()]
        coded = self.tokenizer.encode_batch_fast(regular, add_special_tokens=False) if regular else []
        return {u: np.array(e.ids, dtype="<u4").tobytes() for u, e in zip(regular, coded)}


def text_chunks(texts: Iterable[str], max_chars: int = 12_000_000) -> Iterator[list[int]]:
    """Runs of positions whose texts hold about ``max_chars``, so that work in flight stays bounded."""
    return chunks_of_lengths(map(len, texts), max_chars)


def chunks_of_lengths(lengths: Iterable[int], max_chars: int) -> Iterator[list[int]]:
    run: list[int] = []
    chars = 0
    for k, length in enumerate(lengths):
        run.append(k)
        chars += length
        if chars >= max_chars:
            yield run
            run, chars = [], 0
    if run:
        yield run
