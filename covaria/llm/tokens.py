"""Operator 1: token counts of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SLICE_CHARS = 1 << 18
BATCH_BYTES = 1 << 18
GROUP_CHARS = 1 << 21
MEMO_CHARS = 1 << 23
MARK = "▁"

# No piece of the model has a space after another character, so no merge spans the gap
# before a space that follows something else; the begin mark of the next part stands
# for that space.
GAP = re.compile("(?<=[^ ▁]) ")


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        if "▁" in model.id_to_piece(i).lstrip("▁"):
            raise ValueError("a piece of this model spans a gap between words")
    return model


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Cut a long text at gaps, the first one at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        gap = GAP.search(text, start + size)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.end()
    yield text[start:]


class Counter:
    """Counts of parts between gaps: each unknown part is encoded once, in batches of like bytes."""

    def __init__(self, path: str):
        self.model = _model(path)
        self.memo: dict[str, int] = {}
        self.chars = 0

    def _learn(self, parts: set[str]) -> None:
        """Encode unknown parts, shortest first, in batches of about ``BATCH_BYTES``."""
        held, load = [], 0
        for part in sorted(parts, key=len):
            held.append(part)
            load += len(part)
            if load >= BATCH_BYTES:
                self._encode(held)
                held, load = [], 0
        self._encode(held)

    def _encode(self, parts: list[str]) -> None:
        lengths = map(len, self.model.encode(parts, num_threads=1))
        self.memo.update(zip(parts, lengths, strict=True))
        self.chars += sum(map(len, parts))

    def _settle(self, group: list[tuple[int, list[str]]], totals: list[int]) -> None:
        if self.chars > MEMO_CHARS:
            self.memo, self.chars = {}, 0
        memo = self.memo
        self._learn(set().union(*(parts for _, parts in group)).difference(memo))
        memo[""] = 1  # what follows a gap at the end: the mark alone
        for place, parts in group:
            totals[place] += sum(map(memo.__getitem__, parts))

    def counts(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        group: list[tuple[int, list[str]]] = []
        load = 0
        for place, text in enumerate(texts):
            if not text:
                continue
            for piece in slices(text):
                rare = piece[:1] == " " or "  " in piece or MARK in piece
                group.append((place, GAP.split(piece) if rare else piece.split(" ")))
                load += len(piece)
                if load >= GROUP_CHARS:
                    self._settle(group, totals)
                    group, load = [], 0
        self._settle(group, totals)
        return totals


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated
    rows are counted each; other columns are ignored. Texts are read whole. One whose
    characters offer no gap is encoded in one piece.
    """

    def encoded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in tables:
            texts = batch.column("text")
            sizes = [0 if s is None else s for s in pa.compute.binary_length(texts).to_pylist()]
            found = counter.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encoded, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
