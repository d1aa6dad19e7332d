"""Wide CSV files with different columns: read in one scan, written in blocks of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import scale

KEY = "empi_indexdt"
CELL = ',("[^"]*(?:""[^"]*)*"|[^,]*)'
# Cells that stand for no value.
MISSING = ("", "NA")


def cells_of(line: Column) -> Column:
    """Cells of one CSV line; quoted ones may hold commas and doubled quotes, no line breaks."""
    # With a comma before it, every cell is found the same way.
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), inner(c)).otherwise(c))


def quoted(cell: Column) -> Column:
    """A cell as ``cells_of`` reads it."""
    marked = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[",]'), marked).otherwise(cell)


def read_wide(
    spark: SparkSession, paths: Sequence[str], name: str, value: str, kind: str, key: str = KEY
) -> DataFrame:
    """(key, ``name``, ``value``, source) of all cells with a value, by one scan of all files.

    Every file has a header of its own, which names the key column in any case and place;
    a file without it is an error. ``source`` is the first part of a path that ends in
    ``.csv``. Counts may be written as decimals. Empty cells and ``NA`` have no row.
    """
    text = F.regexp_replace("value", "\r$", "")
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).select(
        F.col("_metadata")["file_path"].alias("file"),
        F.col("_metadata")["file_block_start"].alias("start"),
        F.monotonically_increasing_id().alias("place"),
        text.alias("line"),
    )
    # The first line of a file is the first row of its first block.
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("line", "place").alias("line"))
    heads = scale.staged(heads.where(F.col("line") != ""), "wide-headers")
    names = heads.select("file", F.posexplode(cells_of(F.col("line"))).alias("place", name))
    keyed = names.where(F.lower(name) == key.lower()).groupBy("file").agg(F.min("place").alias("key_place"))
    lost = heads.join(keyed, "file", "left_anti").select("file").limit(5).collect()
    if lost:
        raise ValueError(f"no column {key} in {[r['file'] for r in lost]}")
    marks = heads.select("file", F.md5(F.col("line").cast("binary")).alias("head")).join(keyed, "file")
    rows = scale.sized_join(lines.select("file", "line"), marks, ["file"], F.col("line"))
    rows = rows.where((F.col("line") != "") & (F.md5(F.col("line").cast("binary")) != F.col("head")))
    split = rows.select("file", "key_place", cells_of(F.col("line")).alias("cells"))
    cells = split.select(
        "file",
        "key_place",
        F.get("cells", F.col("key_place")).alias(key),
        F.posexplode("cells").alias("place", "cell"),
    )
    cells = cells.where((F.col("place") != F.col("key_place")) & ~F.col("cell").isin(*MISSING))
    found = scale.sized_join(cells.drop("key_place"), names, ["file", "place"], F.col(key))
    return found.select(
        key,
        name,
        F.col("cell").cast("double").cast(kind).alias(value),
        F.regexp_extract("file", r"([^/=]*\.csv)(?:/.*)?$", 1).alias("source"),
    )


def write_blocks(
    features: DataFrame,
    vocabulary: DataFrame,
    path: str,
    stem: str,
    key: str = KEY,
    width: int = 1000,
    parts: int = 4,
) -> None:
    """The whole matrix of ``features`` (key, feature, value) as files of ``width`` columns at most.

    ``vocabulary`` is (feature, rank) with ranks from 1; columns go by rank, block b to
    ``<stem>_<b>.csv`` in ``path``. One job writes all blocks. A block has up to ``parts`` files,
    each with the block's header, so its rows are not in one task. Keys without a feature in a
    block have no row there.
    """
    block = F.floor((F.col("rank") - 1) / width).cast("int") + 1
    placed = vocabulary.select("feature", block.alias("block"), ((F.col("rank") - 1) % width).cast("int").alias("place"))
    coded = scale.sized_join(features.select(key, "feature", "value"), placed, ["feature"], F.col(key))
    held = F.map_from_entries(F.collect_list(F.struct("place", F.col("value").cast("string"))))
    rows = coded.groupBy(key, "block").agg(held.alias("held"))
    heads = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "feature"))).alias("names"))
    sizes = heads.select("block", F.size("names").alias("n"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("held", i))
    line = F.concat(quoted(F.col(key)), F.lit(","), F.array_join(cells, ",", ""))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    # One row a block: n columns, so the sizes are as few as the blocks.
    lines = rows.join(F.broadcast(sizes), "block").select("block", part.alias("part"), F.lit(1).alias("below"), line.alias("value"))
    lines = scale.staged(lines, "wide-lines")
    used = lines.select("block", "part").distinct()
    header = F.concat(F.lit(key), F.lit(","), F.array_join(F.transform("names.feature", quoted), ","))
    tops = used.join(heads, "block").select("block", "part", F.lit(0).alias("below"), header.alias("value"))
    whole = tops.unionByName(lines).withColumn("source", F.concat(F.lit(f"{stem}_"), F.col("block"), F.lit(".csv")))
    # Sorted by the folders first, the rows are written in this order: the header leads each file.
    sorted_rows = whole.repartition("source", "part").sortWithinPartitions("source", "part", "below", "value")
    sorted_rows.select("source", "part", "value").write.mode("overwrite").partitionBy("source", "part").text(path)
