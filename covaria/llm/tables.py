"""Small helpers shared by the operators: reading, staging, text slices and word hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from covaria.operators import scale

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    return scale.staged(df, f"llm-{name}")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words and then begun anew."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers with random-looking bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter text is one run of all its words."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def records(batch: pa.RecordBatch, *names: str, width: int = 400) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples, a few at a time, so that few texts are held twice."""
    for at in range(0, batch.num_rows, width):
        part = batch.slice(at, width)
        yield from zip(*(part.column(name).to_pylist() for name in names), strict=True)


def batches(rows: Iterator[tuple], width: int, weight, limit: int) -> Iterator[list[tuple]]:
    """Cut a stream of rows into lists of at most ``width`` rows or about ``limit`` weight."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row)
        if len(held) >= width or load >= limit:
            yield held
            held, load = [], 0
    if held:
        yield held
