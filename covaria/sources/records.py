"""CSV files read by byte ranges although quoted fields hold line breaks.

Spark's text reader cuts a file anywhere and gives each slice whole lines, but whether a
line begins a record depends on all quotes before it. Each slice is therefore read from both
states, outside and inside of quotes, into a summary; the summaries of a file, in order, fix
the state and the byte offset of every slice. A second pass cuts the slices into records,
and the pieces of a record that crosses slices are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.operators import scale

FILE_BITS = 40  # of a record number: its byte offset; the bits above count the files
QUOTE = b'"'

SUMMARY = (
    "file string, start long, bytes long, quoted_from_out boolean, last_from_out long, "
    "quoted_from_in boolean, last_from_in long"
)
STATE = "file string, start long, quoted boolean, offset long, open long"
PIECE = "file string, offset long, start long, record binary, whole boolean"


def quoted_after(line: bytes, quoted: bool) -> bool:
    """Is the end of ``line`` inside quotes, when its beginning is or is not?

    A field is quoted if it begins with a quote; two quotes in it are one sign. Whatever
    follows its closing quote belongs to the field up to the next comma.
    """
    at = 0
    if not quoted:
        if line.startswith(QUOTE):
            quoted, at = True, 1
        else:
            at = line.find(b',"') + 2
            quoted = at > 1
    while quoted:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line.startswith(QUOTE, at + 1):
            at += 2
            continue
        at = line.find(b',"', at + 1) + 2
        quoted = at > 1
    return False


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    return rows.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, Iterator[bytes]]]:
    """(file, start, first row, lines) of each slice; a task reads the lines of a slice in order."""
    held: list = []

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield from batch.slice(at, 1000).to_pylist()

    source = rows()
    row = next(source, None)
    while row is not None:
        name, first = (row["file"], row["start"]), row

        def lines():
            nonlocal row
            while row is not None and (row["file"], row["start"]) == name:  # noqa: B023
                yield row["line"]
                row = next(source, None)

        held = lines()
        yield *name, first, held
        for _ in held:  # what the reader left
            pass


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice and from both states: the state at its end, and where its last record begins."""
    for file, start, _, lines in _slices(batches):
        at = 0
        quoted, last = [False, True], [-1, -1]
        for line in lines:
            for i in (0, 1):
                if not quoted[i]:
                    last[i] = at
            if QUOTE in line:
                quoted = [quoted_after(line, q) for q in quoted]
            at += len(line) + 1
        yield _batch([(file, start, at, quoted[0], last[0], quoted[1], last[1])], SUMMARY)


def _fixed(file: tuple, table: pa.Table) -> pa.Table:
    """The true state of each slice of a file. A file has a row for each of its slices, no more."""
    rows, quoted, offset, last = [], False, 0, 0
    for row in sorted(table.to_pylist(), key=lambda r: r["start"]):
        rows.append((row["file"], row["start"], quoted, offset, last if quoted else None))
        side = "in" if quoted else "out"
        if row[f"last_from_{side}"] >= 0:
            last = offset + row[f"last_from_{side}"]
        quoted, offset = row[f"quoted_from_{side}"], offset + row["bytes"]
    return pa.Table.from_batches([_batch(rows, STATE)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of those that begin or end in another slice."""
    for file, start, first, lines in _slices(batches):
        out: list[tuple] = []
        quoted, at, begin = first["quoted"], first["offset"], first["open"]
        held: list[bytes] = []
        whole, load = not quoted, 0
        for line in lines:
            if not quoted:
                begin, whole = at, True
            held.append(line)
            at += len(line) + 1
            if QUOTE in line:
                quoted = quoted_after(line, quoted)
            if not quoted:
                record = b"\n".join(held)
                out.append((file, begin, start, record, whole))
                load += len(record)
                held = []
            if len(out) >= 5000 or load > 1 << 24:
                yield _batch(out, PIECE)
                out, load = [], 0
        if held:
            out.append((file, begin, start, b"\n".join(held), False))
        yield _batch(out, PIECE)


def csv_records(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, file_number, offset, record) of every record below ``path``, headers and empty lines left out.

    ``offset`` is the byte at which the record begins and ``file_number`` counts the files by
    name, so neither depends on how the files were cut. The text of a record has the
    quotes and line breaks of the file. One file is read by as many tasks as it has slices.
    """
    lines = _lines(spark, path, glob)
    summaries = scale.staged(lines.mapInArrow(_summaries, SUMMARY), "csv-slices")
    states = summaries.groupBy("file").applyInArrow(_fixed, STATE)
    states = scale.staged(states, "csv-states")
    # A slice is a split of a file, 128 MiB by default, and its state about 100 bytes, so a
    # broadcast of the usual limit serves 300 TB; beyond it the files are read in groups.
    groups = -(-max(1, scale.held_bytes(states)) // scale.BROADCAST_BYTES)
    parts = []
    for i in range(groups):
        own = F.pmod(F.xxhash64("file"), F.lit(groups)) == i
        # A broadcast join leaves the lines in the order of the file.
        marked = lines.where(own).join(F.broadcast(states.where(own)), ["file", "start"])
        parts.append(marked.mapInArrow(_pieces, PIECE))
    pieces = parts[0]
    for part in parts[1:]:
        pieces = pieces.unionByName(part)
    pieces = scale.staged(pieces, "csv-pieces")
    whole = pieces.where("whole").select("file", "offset", "record")
    broken = pieces.where("NOT whole").groupBy("file", "offset")
    broken = broken.agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["record"].cast("string")), "\n")
    records = whole.select("file", "offset", F.col("record").cast("string").alias("record"))
    records = records.unionByName(broken.select("file", "offset", text.alias("record")))
    # As many rows as files.
    number = F.row_number().over(Window.orderBy("file")) - 1
    numbers = states.select("file").distinct().select("file", number.alias("file_number"))
    records = scale.sized_join(records, numbers, ["file"], F.col("offset"))
    record = F.regexp_replace("record", "\r$", "")
    records = records.where((F.col("offset") > 0) & (record != ""))
    return records.select("file", "file_number", "offset", record.alias("record"))


def record_number(file_number, offset):
    """One number for file and offset, the same however the files were cut."""
    return F.shiftleft(file_number.cast("long"), FILE_BITS) + offset
