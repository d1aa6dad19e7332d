"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

Only DataFrame functions are used. Items are put into partitions by their number of
shingles. The sketch of an item is its bottom-k MinHash under one hash order, with k set
by the partition: as many shingles as a match may lack, and ``SPARE`` more. A document
that contains the wanted share of an item lacks at most that many, so it holds at least
``SPARE`` + 1 shingles of the sketch (or all of a smaller item): no match is lost. Documents
with that many hits are candidates; they are read again and verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.llm.tables import staged
from covaria.operators import scale

WORDS = 5
CONTAINMENT = 0.8
SPARE = 4
SLICE_WORDS = 4096


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_remove(parts, "")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def sliced(texts: DataFrame, *kept: str, size: int = WORDS) -> DataFrame:
    """The columns ``kept`` and ``shingles``: long texts come in slices of ``SLICE_WORDS`` shingles.

    A shingle is the hash of ``size`` words; a shorter text has no row. The outer explode
    keeps Catalyst from copying the word split into a filter, and stands between the
    word hashes and the lambda, which would else split the text anew for each shingle.
    """
    hashes = texts.select(*kept, hashed(words(F.col("text"))).alias("h"))
    last = F.size("h") - F.lit(size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(SLICE_WORDS)))
    parts = hashes.select(*kept, "h", F.explode_outer(starts).alias("start"))
    parts = parts.where(F.col("start").isNotNull())
    end = F.least(F.col("start") + F.lit(SLICE_WORDS - 1), last)
    rows = F.transform(
        F.sequence(F.col("start"), end),
        lambda i: F.xxhash64(*(F.element_at(F.col("h"), i + k) for k in range(size))),
    )
    return parts.select(*kept, rows.alias("shingles"))


def named(items: DataFrame) -> DataFrame:
    """``items`` with ``item``, the digest of its words."""
    return items.withColumn("item", F.md5(F.array_join(words(F.col("text")), " ")))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, shingles, q) of distinct items; ``shingles`` has each once."""
    parts = sliced(named(items).dropDuplicates(["item"]), "item")
    single = parts.select("item", F.explode("shingles").alias("shingle"))
    grouped = single.groupBy("item").agg(F.collect_set("shingle").alias("shingles"))
    return grouped.withColumn("q", F.size("shingles"))


def sketches(shingled: DataFrame, containment: float, spare: int = SPARE) -> DataFrame:
    """(shingle, item, need): bottom-k MinHash by item, and the hits a match must have.

    The size partition of an item is the power of two above its shingle count; k covers
    what the largest item of the partition may lack.
    """
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("q").cast("double"))))
    lack = F.floor(F.col("q") * F.lit(1 - containment) + F.lit(1e-9)).cast("int")
    k = F.least(F.col("q"), F.floor(top * F.lit(1 - containment)).cast("int") + F.lit(spare + 1))
    ordered = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("o"), s.alias("s"))))
    chosen = shingled.select(
        "item", F.explode(F.slice(ordered, F.lit(1), k)).alias("x"), (k - lack).alias("need")
    )
    return chosen.select(F.col("x.s").alias("shingle"), "item", "need")


def candidates(docs: DataFrame, shingled: DataFrame, containment: float) -> DataFrame:
    """(doc_id, item): documents with enough hits in the sketch of an item."""
    sketch = staged(sketches(shingled, containment), "sketches")
    probes = sliced(docs, "doc_id").select("doc_id", F.explode("shingles").alias("shingle"))
    if scale.small(sketch):
        hits = probes.join(F.broadcast(sketch), "shingle")
    else:
        hits = scale.salted_join(probes, sketch, ["shingle"], F.col("doc_id"))
    counted = hits.groupBy("doc_id", "item", "need").agg(F.count_distinct("shingle").alias("hits"))
    return counted.where(F.col("hits") >= F.col("need")).select("doc_id", "item")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, shingles) of every item of which a document holds enough.

    ``docs`` (doc_id, text) and ``items`` (item_id, text): an item matches when at least
    ``containment`` of its distinct shingles of five words are in the document. Rows that
    share a doc_id are one document. Items and documents under five words, and null or
    empty texts, match nothing; rows without a doc_id or item_id are left out; items with
    the same words each have their rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.where(F.col("doc_id").isNotNull())
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.where(F.col("item_id").isNotNull()).distinct()
    shingled = staged(item_shingles(items), "items")
    pairs = staged(candidates(docs, shingled, containment), "candidates")
    wholes = sliced(docs.join(pairs, "doc_id"), "doc_id", "item")
    if scale.small(shingled):
        both = wholes.join(F.broadcast(shingled.withColumnRenamed("shingles", "own")), "item")
    else:
        both = wholes.join(shingled.withColumnRenamed("shingles", "own"), "item")
    shared = both.select(
        "doc_id", "item", "q", F.explode(F.array_intersect("own", "shingles")).alias("shingle")
    )
    found = shared.groupBy("doc_id", "item", "q").agg(
        F.count_distinct("shingle").alias("shared")
    )
    matches = found.where(F.col("shared") >= F.col("q") * F.lit(containment) - F.lit(1e-9))
    names = named(items).select("item_id", "item").distinct()
    shown = matches.join(names, "item")
    return shown.select("doc_id", "item_id", "shared", F.col("q").cast("long").alias("shingles"))
