"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one string and encoded once, with the character
offsets of each token. The spans of the assistants' texts in the string are sorted, and
so are the token spans; binary search finds the tokens of each turn. The marks of
turns are tokens of their own to the tokenizer, so a token never reaches over the
edge of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.tokens import tokenizer_path

# The marks of the template, and control strings of common templates. None
# of them stands unescaped in a text or a role.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = [
    TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<unk>", "<pad>",
]
ESCAPE = "\\"
# A control string with any number of escapes after its first character.
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)

_TOKENIZERS: dict = {}


def escape(text: str) -> str:
    """Put one more escape into each control string; ``unescape`` takes it out again."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The string of a conversation and the span and role of each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        # Offsets with the blank that begins a token.
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        tokenizer.add_special_tokens([AddedToken(t, normalized=False) for t in (TURN, BODY, END)])
        _TOKENIZERS[path] = tokenizer
    return _TOKENIZERS[path]


def loss_mask(offsets: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in one of the sorted, disjoint spans."""
    mask = np.zeros(len(offsets), dtype=bool)
    for start, end in spans:
        first = np.searchsorted(offsets[:, 0], start, side="left")
        last = np.searchsorted(offsets[:, 1], end, side="right")
        mask[first:last] = True
    return mask


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The pieces of the string under the mask: one for each run of masked tokens."""
    runs = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    # Several tokens may share a character; the run ends where its furthest one ends.
    return [formatted[offsets[a, 0] : offsets[a:b, 1].max()] for a, b in zip(runs[::2], runs[1::2])]


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_role: str = "assistant",
    tokenizer: str | None = None,
) -> DataFrame:
    """``conv_id, formatted, ids, loss, spans`` of every conversation.

    ``ids`` and ``loss`` (0 or 1) go token by token, ``spans`` are the start and end
    of each token in ``formatted``, one after the other. Turns go by ``turn``, null
    first; ties by role and text. A null text or role is an empty one; empty texts
    have no token. Rows that repeat are turns of their own; rows without a
    conversation id are one conversation with a null id. Other columns are not looked at;
    an empty table gives an empty result.

    A conversation is one string and so one row. Its turns are sorted by Spark and
    come to a task as a stream, which holds one conversation at a time.
    """
    path = tokenizer or tokenizer_path()
    schema = "conv_id long, formatted string, ids array<int>, loss array<tinyint>, spans array<int>"

    def build(conv_id, turns: list[tuple[str, str]]) -> tuple:
        formatted, spans = render(turns)
        coded = _tokenizer(path).encode(formatted, add_special_tokens=False)
        offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, [(a, b) for a, b, role in spans if role == learn_role])
        return conv_id, formatted, coded.ids, mask.astype(np.int8), offsets.ravel().astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "formatted", "ids", "loss", "spans"]
        key, turns, out, chars = None, [], [], 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

        for batch in batches:
            ids = [None if i is pd.NA else int(i) for i in batch["conv_id"].astype("Int64")]
            for conv_id, role, text in zip(ids, batch["role"], batch["text"]):
                if turns and conv_id != key:
                    out.append(build(key, turns))
                    turns, chars = [], chars + len(out[-1][1])
                    if chars > 1_000_000:
                        yield rows()
                        out, chars = [], 0
                key = conv_id
                turns.append((role, text))
        if turns:
            out.append(build(key, turns))
        if out:
            yield rows()

    def empty_for_null(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    plain = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        empty_for_null(role_col).alias("role"),
        empty_for_null(text_col).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return plain.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInPandas(
        run, schema
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the strings, offsets and masks alone, digested."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, text, loss, spans in zip(
                batch["conv_id"].astype("Int64"), batch["formatted"], batch["loss"], batch["spans"]
            ):
                turns = parse(text)
                every = "".join(f"{role}\n{body}\n" for role, body in turns)
                offsets = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
                learned = "".join(map(unescape, masked_texts(text, offsets, np.asarray(loss, dtype=bool))))
                out.append((conv_id, len(turns), _sha256(every), len(learned), _sha256(learned), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
