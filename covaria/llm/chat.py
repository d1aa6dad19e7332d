"""Operator 4: chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"

# The control strings of the template. A turn is
# <s>role[INST]text[/INST]</s>, with role and text escaped.
OPEN, MIDDLE, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)

Span = tuple[int, int]


def escaped(text: str) -> str:
    """No control string is left: a backslash follows its first character."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[Span]]:
    """One string for the conversation, and the span of each turn's escaped text in it."""
    parts, spans, place = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}{MIDDLE}", escaped(text)
        tail = CLOSE + END
        spans.append((place + len(head), place + len(head) + len(body)))
        parts += (head, body, tail)
        place += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescaped(role), unescaped(text)) for role, text in TURN.findall(formatted)]


def masked(offsets: np.ndarray, spans: Sequence[Span]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens meet a span, and the parts of their characters inside the spans.

    ``offsets`` holds (start, end) by token, in order; tokens of one character share its
    offsets. A token across the edge of a span counts with its inner part only, and no
    character counts twice.
    """
    mask = np.zeros(len(offsets), np.int8)
    starts, ends = [], []
    if len(offsets):
        tops = np.maximum.accumulate(offsets[:, 1])
        for left, right in spans:
            if left == right:
                continue
            first = np.searchsorted(tops, left, side="right")
            last = np.searchsorted(offsets[:, 0], right, side="left")
            inner = offsets[first:last].clip(left, right)
            before = np.concatenate([[left], np.maximum.accumulate(inner[:, 1])[:-1]])
            mask[first:last] = 1
            starts.append(np.maximum(inner[:, 0], before))
            ends.append(np.maximum(inner[:, 1], starts[-1]))
    empty = np.zeros(0, np.int64)
    return mask, np.concatenate([empty, *starts]), np.concatenate([empty, *ends])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


FORMATTED = (
    "conv_id long, formatted string, token_ids array<int>, loss_mask array<tinyint>, "
    "loss_starts array<long>, loss_ends array<long>"
)


def formatted(rows: DataFrame, tokenizer_path: str, learn: str = "assistant") -> DataFrame:
    """One training example per conversation of ``rows`` (conv_id, turn, role, text).

    Turns come in the order of ``turn``, then role, then text; a null turn comes first.
    Null roles and texts are empty; repeated rows are turns of their own; rows without a
    conv_id are one conversation. ``loss_mask`` marks the tokens that meet a text of the
    role ``learn``; ``loss_starts`` and ``loss_ends`` hold their characters (code points)
    inside those texts. Other columns are ignored. A conversation is one example, so its
    turns meet in one row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for turns in batch.column("turns").to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                whole, spans = render(pairs)
                encoded = tokenizer.encode(whole, add_special_tokens=False)
                offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
                wanted = [s for s, (role, _) in zip(spans, pairs, strict=True) if role == learn]
                for column, value in zip(out, (whole, encoded.ids, *masked(offsets, wanted)), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), *[pa.list_(pa.int64())] * 2)
            arrays = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
            names = ["conv_id", "formatted", "token_ids", "loss_mask", "loss_starts", "loss_ends"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names)

    said = rows.select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return whole.mapInArrow(encode, FORMATTED)


def digests(examples: DataFrame) -> DataFrame:
    """What can be read back from ``formatted``: turns and the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            columns = (batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))
            for whole, starts, ends in zip(*columns, strict=True):
                turns = parse(whole)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                lost = unescaped("".join(whole[a:b] for a, b in zip(starts, ends, strict=True)))
                row = (len(turns), _sha(said), len(lost), _sha(lost), len(whole))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, out)], names)

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )
    return examples.mapInArrow(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
