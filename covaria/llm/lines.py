"""Operator 13: repeated lines by range-partitioned hashes and keep bitmaps.

Every line becomes a row of its key's 128-bit hash, its document and its position; no text
is shuffled for the search. The rows are partitioned by ranges of (hash, document), so a line
of a third of all documents fills many slices, and sorted by position inside them. A slice
is read as a stream that holds the rows of one hash until enough documents have shown it.
Only the first and the last hash of a slice can go on in another one; their rows wait for
the sum of at most two summaries a slice. Each document gets a compressed bitmap of the
lines that it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.llm.tables import records, staged

LEAST_DOCS = 10
BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its doc_id and text; equal rows share them."""
    mark = F.when(text.isNull(), F.lit("!")).otherwise(F.lit(":"))
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), mark, F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(named.cast("binary")))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line with a key, and one of position -1 - lines for the document itself."""
    names = ["line", "doc_id", "row", "at"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int32()]
    for batch in batches:
        held: tuple[list, ...] = ([], [], [], [])
        for doc_id, row, text in records(batch, "doc_id", "row", "text"):
            lines = (text or b"").split(b"\n")
            keys = [(i, key) for i, key in enumerate(map(key_of, lines)) if key]
            held[0].extend([None, *(xxhash.xxh3_128_digest(key) for _, key in keys)])
            held[1].extend([doc_id] * (len(keys) + 1))
            held[2].extend([row] * (len(keys) + 1))
            held[3].extend([-1 - len(lines), *(i for i, _ in keys)])
            if len(held[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, types, strict=True)], names)
                held = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, types, strict=True)], names)


FOUND = "slice int, line binary, row binary, at int, lead boolean, docs int"


def _streamed(least: int):
    """Reader of a sorted slice.

    It gives the rows of lines in enough documents (docs null), those of the slice's first and
    last hash that may reach enough in other slices (docs 0), and for these two hashes a
    summary (row null) of their documents. ``lead`` marks a hash's first row in the slice.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part = TaskContext.get().partitionId()
        now, docs, last, wait, first = None, 0, None, [], True

        def close(edge: bool) -> None:
            if now is not None and edge:
                if docs < least:
                    out.extend((part, now, row, at, lead, 0) for row, at, lead in wait)
                out.append((part, now, None, None, None, docs))

        for batch in batches:
            for line, doc_id, row, at in records(batch, "line", "doc_id", "row", "at", width=10_000):
                lead = line != now
                if lead:
                    close(first)
                    first = now is None
                    now, docs, wait = line, 0, []
                if lead or doc_id != last:
                    docs, last = docs + 1, doc_id
                if docs < least:
                    wait.append((row, at, lead))
                    continue
                out.extend((part, now, r, a, x, None) for r, a, x in wait)
                wait = []
                out.append((part, now, row, at, lead, None))
            if len(out) > 20_000:
                yield _found(out)
                out.clear()
        close(True)
        yield _found(out)

    return stream


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int32()]
    names = ["slice", "line", "row", "at", "lead", "docs"]
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def packed(keep: np.ndarray) -> bytes:
    """A keep bitmap: one bit a line, compressed."""
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False) -> DataFrame:
    """(row, n_lines, n_dropped, keep) of every different row of ``docs`` (doc_id, text).

    ``row`` is ``row_key`` of the row. Lines whose key is found in ``least_docs`` documents are
    dropped, or with ``keep_first`` all but the first in the order of doc_id and position.
    A document is a doc_id: rows of one doc_id, and rows without one, count once. Lines with
    an empty key stay. A null or empty text is one empty line.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    chosen = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), text.cast("binary").alias("text"))
    rows = staged(chosen.mapInArrow(_lines, "line binary, doc_id long, row binary, at int"), "line-rows")
    lines = rows.where(F.col("line").isNotNull())
    sliced = lines.repartitionByRange("line", "doc_id").sortWithinPartitions("line", "doc_id", "at", "row")
    found = staged(sliced.mapInArrow(_streamed(least_docs), FOUND), "line-found")
    # At most two summaries a slice, so the sums are as few as the slices.
    ends = found.where(F.col("row").isNull()).groupBy("line").agg(F.sum("docs").alias("total"), F.min("slice").alias("begin"))
    marked = found.where(F.col("row").isNotNull()).join(F.broadcast(ends), "line", "left")
    marked = marked.where(F.col("docs").isNull() | (F.col("total") >= least_docs))
    if keep_first:
        marked = marked.where(~(F.col("lead") & (F.col("slice") == F.coalesce("begin", "slice"))))
    heads = rows.where(F.col("line").isNull()).select("row", "at")
    grouped = heads.union(marked.select("row", "at")).groupBy("row").agg(F.collect_set("at").alias("at"))
    return grouped.mapInArrow(_bitmaps, "row binary, n_lines long, n_dropped long, keep binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, dropped, kept = [], [], [], []
        for row, places in records(batch, "row", "at"):
            places = np.array(places, np.int64)
            keep = np.ones(-1 - int(places.min()), bool)
            keep[places[places >= 0]] = False
            keys.append(row)
            sizes.append(len(keep))
            dropped.append(len(keep) - int(keep.sum()))
            kept.append(packed(keep))
        columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_lines", "n_dropped", "keep"])


def kept_text(text: bytes | None, bitmap: bytes, n_lines: int) -> bytes:
    lines = (text or b"").split(b"\n")
    return b"\n".join(line for line, keep in zip(lines, unpacked(bitmap, n_lines), strict=True) if keep)


def applied(docs: DataFrame, bitmaps: DataFrame, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``kept``, n_lines, n_dropped and the text of the lines kept, of every row of ``docs``."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = docs.select(*kept, text.cast("binary").alias("_text"), row_key(doc_id, text).alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept_text(t, k, n) if d else (t or b"") for t, k, n, d in records(batch, "_text", "keep", "n_lines", "n_dropped")]
            columns = [*(batch.column(c) for c in kept), batch.column("n_lines"), batch.column("n_dropped"), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_lines", "n_dropped", "kept_text"])

    joined = named.join(bitmaps, "row").select(*kept, "_text", "n_lines", "n_dropped", "keep")
    shape = joined.select(*kept, "n_lines", "n_dropped", F.col("keep").alias("kept_text")).schema
    return joined.mapInArrow(cut, shape)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = applied(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
