"""Operator 2: near duplicates by BagMinHash, bands and verified multiset overlap.

A text is the multiset of its five-word shingles. For each shingle, Poisson processes run
over its possible counts: one over [0, 1), and one over each [2^j, 2^(j+1)), whose points
fall on a unit cell by fair splits of the interval. A point belongs to a text if its cell
lies below the shingle's count there, and falls on one of the signature's places. The
first point on each place is the signature: two texts agree on a place with the
probability of their weighted Jaccard similarity. Points are made in order of time only
up to a time by which all places are filled.

Texts that agree on a whole band meet in a bucket. Each bucket pair is verified exactly,
unless both texts are already known to be of one class:

1. each text with the text that most often heads its buckets,
2. each text with the other heads of its buckets,
3. of the buckets that still hold several classes, all texts of two classes that share one
   of their rarest shingles (an exact prefix filter, see ``alike_beginnings``).

So a bucket of many copies costs a few checks per text, one of many texts with a passage in
common costs little, and no similar pair of a bucket is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.graph import components
from covaria.llm.tables import WordHashes, batches, mixed, records, shingles, staged, words_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
SPARE_TIME = 2.5
GOLD = np.uint64(0x9E3779B97F4A7C15)
U32 = np.uint64(32)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their counts."""
    return np.unique(shingles(hashes, WORDS), return_counts=True)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], places: int) -> np.ndarray:
    """BagMinHash of each (shingles, counts): one row of ``places`` 64-bit numbers.

    A number holds the time of the first point (upper half) and a label of the point.
    Every text must have a shingle.
    """
    out = np.full((len(texts), places), NONE, np.uint64)
    weight = np.array([counts.sum() for _, counts in texts], np.float64)
    todo = np.arange(len(texts))
    spare = SPARE_TIME
    while len(todo):
        limit = np.zeros(len(texts))
        limit[todo] = (math.log(places) + spare) / weight[todo]
        out[todo] = NONE
        _points([texts[i] for i in todo], todo, limit, out, places)
        todo = todo[(out[todo] == NONE).any(axis=1)]
        spare *= 2
    return out


def _points(texts, owners, limit, out, places) -> None:
    """Run the processes of all texts up to each text's time limit."""
    owner = np.repeat(owners, [len(s) for s, _ in texts])
    shingle = np.concatenate([s for s, _ in texts])
    count = np.concatenate([c for _, c in texts]).astype(np.uint64)
    shell = 0
    while len(shingle):
        low = np.uint64(0 if shell == 0 else 1 << (shell - 1))
        width = 1 if shell < 2 else 1 << (shell - 1)
        state = mixed(shingle + np.uint64(int(GOLD) * (2 * shell + 1) % 2**64))
        _shell(state, owner, count, low, width, limit, out, places)
        inside = count > np.uint64(1 << shell)
        shingle, owner, count = shingle[inside], owner[inside], count[inside]
        shell += 1


def _shell(state, owner, count, low, width, limit, out, places) -> None:
    time = np.zeros(len(state))
    step, block = 0, 1
    rate = float(places * width)
    while len(state):
        turns = np.arange(step + 1, step + block + 1, dtype=np.uint64)
        draws = mixed(state[:, None] + GOLD * turns[None, :])
        gaps = -np.log1p(-(draws >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        soon = times < limit[owner][:, None]
        row, col = np.nonzero(soon)
        bits = mixed(draws[row, col] ^ GOLD)
        if width > 1:
            cell = low + (mixed(bits) & np.uint64(width - 1))  # one fair bit per split
            below = cell < count[row]
        else:
            below = low < count[row]
        row, col, bits = row[below], col[below], bits[below]
        place = ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(places) >> U32).astype(np.int64)
        label = mixed(bits + GOLD) >> U32
        value = (times[row, col].view(np.uint64) >> U32 << U32) | label
        np.minimum.at(out.reshape(-1), owner[row] * places + place, value)
        on = soon[:, -1]
        state, owner, count, time = state[on], owner[on], count[on], times[on, -1]
        step += block
        block = min(2 * block, 32)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, from the labels and times of its places."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(signature), 1))
    for i in range(rows):
        keys = mixed(keys * np.uint64(0xD1B54A32D192ED03) + parts[:, :, i])
    return keys


SIGNED = "doc_id long, digest binary, band_keys array<bigint>"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, band_keys) of every text; a text without words has null in both."""

    def sign(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        stream = (row for batch in tables for row in records(batch, "doc_id", "text"))
        for group in batches(stream, 400, lambda r: len(r[1] or ""), 1 << 20):
            digests: list[bytes | None] = []
            bags = []
            for _, text in group:
                words = words_of(text)
                digests.append(xxhash.xxh128_digest(" ".join(words).encode()) if words else None)
                if words:
                    bags.append(weighted(hashes.of(words)))
            keys = iter(())
            if bags:
                found = band_keys(signatures(bags, bands * rows), bands, rows)
                keys = iter(found.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in group], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([None if d is None else next(keys) for d in digests], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "band_keys"],
            )

    return docs.mapInArrow(sign, SIGNED)


def bags(docs: DataFrame) -> DataFrame:
    """(node, bag) from (node, text): ``bag`` has the k-th occurrence of a shingle as an element.

    The overlap of two bags as sets is the multiset overlap of the texts.
    """

    def fill(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in tables:
            for group in batches(records(batch, "node", "text"), 400, lambda r: len(r[1] or ""), 1 << 20):
                elements = []
                for _, text in group:
                    found, counts = weighted(hashes.of(words_of(text)))
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    repeated = np.repeat(found, counts) + GOLD * nth.astype(np.uint64)
                    elements.append(mixed(repeated).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in group], pa.int64()), pa.array(elements, pa.list_(pa.int64()))],
                    ["node", "bag"],
                )

    return docs.mapInArrow(fill, "node long, bag array<bigint>")


def verified(pairs: DataFrame, bagged: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose multiset Jaccard similarity reaches ``similarity``.

    A hot head is on one side of a plain equi-join, which adaptive execution can split.
    """
    right = bagged.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    left = bagged.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    sizes = F.size("bag_a") + F.size("bag_b")
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    close = shared * F.lit(1 + similarity) >= sizes * F.lit(similarity) - F.lit(1e-9)
    fits = F.least(F.size("bag_a"), F.size("bag_b")) >= F.greatest(
        F.size("bag_a"), F.size("bag_b")
    ) * F.lit(similarity) - F.lit(1e-9)
    return both.where(fits).where(close).select("a", "b")


def alike_beginnings(bagged: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``bagged`` (node, label, bag) of two labels that may be similar; none is missed.

    With all bags in one order of elements, rarest first, two bags of the wanted similarity
    share an element among the first of each: as many as a bag may lack, and one; and
    behind the first shared one there is room for the wanted overlap in both. What many texts have in common, such as a passage, comes last and pairs nothing. Bags of
    one label are not paired: members of the most frequent label of an element meet only
    the texts of other labels.
    """
    size = F.size("bag")
    sized = bagged.withColumn("first", size - F.ceil(size * F.lit(similarity) - F.lit(1e-9)) + 1)
    known = staged(sized.select("node", "label", size.alias("size"), "first", "bag"), "left")
    elements = known.select("node", F.explode("bag").alias("element"))
    counts = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    common = elements.join(counts.where(F.col("n") > 1), "element")
    ordered = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("common"))
    begun = ordered.join(known.drop("bag"), "node")
    # Elements of one text only come before the common ones and take places.
    places = F.col("first") - (F.col("size") - F.size("common"))
    begun = begun.where(places > 0)
    starts = begun.select(
        "node",
        "label",
        "size",
        F.size("common").alias("commons"),
        F.posexplode(F.slice("common", F.lit(1), places.cast("int"))).alias("i", "x"),
    )
    # The most that can be shared if this is the first element that two bags share.
    rest = F.col("commons") - F.col("i")
    starts = starts.select("node", "label", "size", rest.alias("rest"), F.col("x.element").alias("element"))
    starts = staged(starts, "beginnings")
    held = starts.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("element").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")
    )
    several = staged(starts.join(main.where(F.col("labels") > 1).drop("labels"), "element"), "several")
    outside = several.where(F.col("label") != F.col("main")).select(
        "element", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("size").alias("sx"),
        F.col("rest").alias("rx"),
    )
    wanted = (F.col("size") + F.col("sx")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)
    near = F.least("rest", "rx") >= wanted
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("x"))
    cross = several.join(outside, "element").where((F.col("label") != F.col("lx")) & once & near)
    return cross.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))


def relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, label) after ``links`` (a, b) between nodes unite their labels."""
    ends = links.join(nodes.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(nodes.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    merged = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = merged.select(F.col("node").alias("label"), "component")
    out = nodes.join(merged, "label", "left")
    return staged(out.select("node", F.coalesce("component", "label").alias("label")), "labels")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, class_id, kept) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class; ``kept`` marks its rows. Classes are
    the connected components of the links of at least ``similarity`` over the multisets of
    five-word shingles; texts of under five words are one shingle. Texts without words,
    and null texts, are classes of their own. Rows that share a doc_id are one document
    whose classes unite. Rows without a doc_id have a null class, are kept and link
    nothing. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.where(F.col("doc_id").isNotNull())
    signs = staged(signed(named, bands, rows), "signatures")
    # Equal texts have equal keys: one node for each, called by its smallest doc_id.
    heads = signs.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("band_keys").alias("band_keys")
    )
    heads = staged(heads, "heads")
    spread = heads.select("node", F.explode("band_keys").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")
    )
    shared = sizes.where(F.col("first") != F.col("last")).select("bucket", "n")
    members = staged(spread.join(shared, "bucket"), "members")
    # A bucket is headed by its member with the most fellows over all buckets: of the copies
    # of one text that is the text itself, to which they are closer than to each other.
    fellows = members.groupBy("node").agg(F.sum("n").alias("fellows"))
    heads_of = members.join(fellows, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("fellows", -F.col("node"))).alias("head")
    )
    entries = staged(members.select("bucket", "node").join(heads_of, "bucket"), "entries")

    nodes = entries.select("node").distinct()
    texts = named.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    bagged = staged(bags(texts), "bags")
    labels = staged(nodes.select("node", F.col("node").alias("label")), "labels")

    chosen = (
        entries.where(F.col("node") != F.col("head"))
        .groupBy("node", "head")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("node")
        .agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    )
    first = staged(chosen.select(F.col("head").alias("a"), F.col("node").alias("b")), "pairs")
    labels = relabelled(labels, staged(verified(first, bagged, similarity), "links"))

    def with_label(frame: DataFrame, node: str, label: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(node), F.col("label").alias(label)), node)

    pairs = entries.where(F.col("node") != F.col("head")).select("node", "head").distinct()
    apart = with_label(with_label(pairs, "node", "ln"), "head", "lh").where("ln != lh")
    second = apart.select(F.col("head").alias("a"), F.col("node").alias("b"))
    second = staged(second.join(first, ["a", "b"], "left_anti"), "pairs")
    labels = relabelled(labels, staged(verified(second, bagged, similarity), "links"))

    tagged = staged(with_label(entries, "node", "label"), "tagged")
    classes = tagged.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = classes.where(F.col("low") != F.col("high")).select("bucket")
    left = tagged.join(several, "bucket").select("node", "label").distinct()
    third = alike_beginnings(bagged.join(left, "node"), similarity)
    tried = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    third = staged(third.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    labels = relabelled(labels, staged(verified(third, bagged, similarity), "links"))
    return _classes(docs, signs, heads, labels)


def _classes(docs: DataFrame, signs: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Carry the labels of nodes to all documents."""
    known = heads.select("digest", "node").join(labels, "node", "left")
    known = known.select("digest", F.coalesce("label", "node").alias("label"))
    found = signs.select("doc_id", "digest").join(known, "digest", "left")
    rows = found.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))
    # A document of several texts ties their classes together.
    tied = staged(rows, "rows")
    several = tied.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"))
    links = several.where(F.col("a") != F.col("b"))
    merged = components(links.select("a", "b").union(
        tied.join(links, "doc_id").select("class_id", F.col("a")).where("class_id != a")
    ))
    merged = merged.select(F.col("node").alias("class_id"), "component")
    out = tied.join(merged, "class_id", "left")
    out = out.select("doc_id", F.coalesce("component", "class_id").alias("class_id"))
    unnamed = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return out.union(unnamed).withColumn("kept", kept)
