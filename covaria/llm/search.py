"""Operator 12: ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks of bounded size. A block's row lists its documents; the
posting rows hold, for each term of the items, the block's documents with the term. Terms
have owners by their weight, rare terms first. A bundle is a set of items at one block; it
carries sparse accumulators (document to integer score) of its items from owner to owner,
where a cogroup with the owner's postings of the block adds their contributions.

Between owners the bundles report which scores each item surely reaches. A document is
dropped, or not taken up, once its score plus all that later owners can add lies below the
50th of these, so the result is exact. The last owner's bundles give their best documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.llm.tables import records, staged
from covaria.operators import scale

TOP = 50
BLOCK_DOCS = 4096
BLOCK_BYTES = 1 << 24
BUNDLE_ITEMS = 128
SLICE_BYTES = 1 << 20
VOCABULARY_BYTES = 32 << 20
# Owners by weight: terms in about 1, 10, 50 and 100 percent of the documents.
OWNERS = (4600, 2300, 700, -1)
# The constants of a document's length and of a term's contribution.
LENGTH_PERCENT = 50
UNIT = 1_000_000_000
TF_FACTOR, LENGTH_FACTOR = 1000, 20


def _folded() -> bytes:
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for code in range(128):
        if chr(code).isalnum():
            table[code] = ord(chr(code).lower())
    return bytes(table)


FOLDED = _folded()
GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about ``SLICE_BYTES``, cut between terms."""
    at = 0
    text = text or b""
    while at < len(text):
        gap = GAP.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(FOLDED).split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each; rows of one item_id are one item, rows without one are none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item, text in records(batch, "item_id", "text"):
                own = {t for part in terms_of(text) for t in part}
                ids.extend([item] * len(own))
                terms.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.where(F.col("item_id").isNotNull())
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


INDEX = "block long, term binary, docs binary, tfs binary, lengths binary, n long, most long"


def _blocks(known: frozenset[bytes] | None):
    """Blocks of documents as rows of ``INDEX``.

    A block's own row has no term: ``docs`` are its doc_ids, ``lengths`` their numbers of terms,
    ``n`` its documents with a term and ``most`` all terms. A term's row has the places of
    its documents in the block, its occurrences there, ``n`` documents and the most occurrences.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        lengths: list[int] = []
        places: dict[bytes, list[int]] = {}
        unnamed: Counter = Counter()
        load = n_docs = n_terms = 0

        def rows() -> Iterator[pa.RecordBatch]:
            block = (part << 32) | number
            out = [(block, None, np.array(ids, np.int64).tobytes(), None, np.array(lengths, np.int64).tobytes(), n_docs, n_terms)]
            for term in places.keys() | unnamed.keys():
                pair = np.array(places.get(term, ()), np.int64).reshape(-1, 2)
                at, tf = pair[:, 0].astype(np.uint16).tobytes(), pair[:, 1].astype(np.uint32).tobytes()
                out.append((block, term, at, tf, None, len(pair) + unnamed[term], int(pair[:, 1].max(initial=0))))
                if len(out) >= 20_000:
                    yield _rows(out, INDEX)
                    out = []
            yield _rows(out, INDEX)

        for batch in batches:
            for doc_id, text in records(batch, "doc_id", "text"):
                counts: Counter = Counter()
                length = 0
                for terms in terms_of(text):
                    length += len(terms)
                    counts.update(terms if known is None else filter(known.__contains__, terms))
                n_docs, n_terms, load = n_docs + (length > 0), n_terms + length, load + len(text or b"")
                if doc_id is None:
                    unnamed.update(counts.keys())
                else:
                    for term, tf in counts.items():
                        places.setdefault(term, []).extend((len(ids), tf))
                    ids.append(doc_id)
                    lengths.append(length)
                if len(ids) >= BLOCK_DOCS or load >= BLOCK_BYTES:
                    yield from rows()
                    ids, lengths, places, number = [], [], {}, number + 1
                    unnamed, load, n_docs, n_terms = Counter(), 0, 0, 0
        yield from rows()

    return build


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Block and posting rows of ``docs`` (doc_id, text) for ``terms`` (term).

    Terms that fit ``VOCABULARY_BYTES`` are known to the workers, which then keep no others;
    more are matched with the postings by a join.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    known = None
    if scale.small(terms, VOCABULARY_BYTES):
        known = frozenset(bytes(r["term"]) for r in terms.collect())
    rows = texts.mapInArrow(_blocks(known), INDEX)
    if known is None:
        rows = staged(rows, "postings")
        wanted = rows.where(F.col("term").isNotNull()).join(terms.hint("merge"), "term", "left_semi").select(*rows.columns)
        rows = rows.where(F.col("term").isNull()).unionByName(wanted)
    return staged(rows, "index")


BUNDLE = "block long, bundle int, items binary, places binary, scores binary"
BEST = "block long, bundle int, item_id long, doc_id long, score long"


def _bundles(n_docs: int, n_terms: int, last: bool, top: int):
    """One owner: bundles (left) meet the owner's postings of their block (right).

    ``items``, ``places`` and ``scores`` of a bundle are its accumulators. ``asked`` are the
    items of the bundle with the score that each surely reaches (``sure``) and the most that
    this owner and all later ones can add (``rest``).
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (bundle,) = left.to_pylist()
        size = np.frombuffer(bundle["lengths"], np.int64)
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * size * n_docs) // n_terms
        asked = bundle["asked"]
        postings = []
        uses: dict[int, list[tuple[int, int]]] = {}
        for i, row in enumerate(right.to_pylist()):
            places = np.frombuffer(row["docs"], np.uint16).astype(np.int64)
            tf = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
            postings.append((places, row["w"] * ((UNIT * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * m[places]))))
            for item in row["items"]:
                uses.setdefault(item, []).append(i)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if bundle["items"]:
            items = np.frombuffer(bundle["items"], np.int64)
            places = np.frombuffer(bundle["places"], np.uint16).astype(np.int64)
            scores = np.frombuffer(bundle["scores"], np.int64)
            cuts = np.flatnonzero(np.diff(items)) + 1
            for own, at, score in zip(np.split(items, cuts), np.split(places, cuts), np.split(scores, cuts), strict=True):
                held[int(own[0])] = (at, score)
        out_items, out_places, out_scores = [], [], []
        table = np.zeros(len(size), np.int64)
        for ask in asked:
            item, sure, rest = ask["item_id"], ask["sure"], ask["rest"]
            at, score = held.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            near = score + rest >= sure
            at, score = at[near], score[near]
            table[:] = 0
            table[at] = score
            for i in uses.get(item, ()):
                places, added = postings[i]
                table[places] += added
            # Documents with no score yet are taken up only if they can still get far enough.
            at = np.flatnonzero(table) if rest >= sure else at[table[at] > 0]
            out_items.append(np.full(len(at), item))
            out_places.append(at)
            out_scores.append(table[at])
        if last:
            return _best(bundle, out_items, out_places, out_scores, top)
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (out_items, out_places, out_scores)]
        row = (bundle["block"], bundle["bundle"], columns[0].tobytes(), columns[1].astype(np.uint16).tobytes(), columns[2].tobytes())
        return pa.Table.from_batches([_rows([row], BUNDLE)])

    return meet


def _best(bundle: dict, items: list, places: list, scores: list, top: int) -> pa.Table:
    """The best documents of each item in the block."""
    ids = np.frombuffer(bundle["ids"], np.int64)
    rows = []
    for item, at, score in zip(items, places, scores, strict=True):
        order = np.lexsort((ids[at], -score))[:top]
        rows.extend((bundle["block"], bundle["bundle"], int(i), int(d), int(s)) for i, d, s in zip(item[order], ids[at][order], score[order], strict=True))
    return pa.Table.from_batches([_rows(rows, BEST)])


def _reached(top: int):
    """Of each item in a bundle its best score so far, and the score that ``top`` documents reach."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for items, scores in records(batch, "items", "scores", width=50):
                items, scores = np.frombuffer(items, np.int64), np.frombuffer(scores, np.int64)
                cuts = np.flatnonzero(np.diff(items)) + 1
                for own, score in zip(np.split(items, cuts), np.split(scores, cuts), strict=True):
                    if len(own):
                        certain = int(np.partition(score, -top)[-top]) if len(score) >= top else 0
                        rows.append((int(own[0]), int(score.max()), certain))
            yield _rows(rows, "item_id long, score long, certain long")

    return read


def _sure(bundles: DataFrame, plan: DataFrame, top: int) -> DataFrame:
    """(item_id, sure): a score that ``top`` documents reach, within one block or as the best of ``top`` blocks."""
    seen = bundles.select("items", "scores").mapInArrow(_reached(top), "item_id long, score long, certain long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    blocks = seen.select("item_id", "score", F.row_number().over(order).alias("at")).where(F.col("at") <= top)
    blocks = blocks.where(F.col("at") == top).select("item_id", "score")
    sure = seen.select("item_id", F.col("certain").alias("score")).union(blocks).groupBy("item_id").agg(F.max("score").alias("sure"))
    return plan.select("item_id").join(sure, "item_id", "left").select("item_id", F.coalesce("sure", F.lit(0)).cast("long").alias("sure"))


def _weighed(rows: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """(bundle, item_id, term, w, most, owner) of the items' terms; ``most`` bounds a contribution."""
    postings = rows.where(F.col("term").isNotNull())
    found = postings.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("tf"))
    w = F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    least = LENGTH_FACTOR * (100 - LENGTH_PERCENT)
    most = F.expr(f"w * (({UNIT} * tf) div ({TF_FACTOR} * tf + {least}))")
    owner = F.lit(len(OWNERS) - 1)
    for i in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("w") >= OWNERS[i], F.lit(i)).otherwise(owner)
    found = found.withColumn("w", w).select("term", "w", most.alias("most"), owner.alias("owner"))
    n_bundles = max(1, -(-asked.select("item_id").distinct().count() // BUNDLE_ITEMS))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int")
    return staged(scale.sized_join(asked, found, ["term"], F.col("item_id")).withColumn("bundle", bundle), "item-weights")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    ``docs`` is (doc_id, text), ``items`` (item_id, text); other columns are ignored. Null and
    empty texts have no term. Every row of ``docs`` is a document of its own and counts in
    the statistics; rows without a doc_id are not returned. Rows of one item_id are one item;
    rows without one are left out. Equal scores go by doc_id.
    """
    asked = staged(item_terms(items), "item-terms")
    rows = index(docs, asked.select("term").distinct())
    heads = rows.where(F.col("term").isNull())
    sums = heads.agg(F.sum("n").alias("docs"), F.sum("most").alias("terms")).first()
    n_docs, n_terms = int(sums["docs"] or 0), max(1, int(sums["terms"] or 0))
    terms = _weighed(rows, asked, n_docs)
    owners = list(range(len(OWNERS)))
    plan = staged(terms.groupBy("bundle", "item_id").pivot("owner", owners).agg(F.sum("most")).na.fill(0), "search-plan")
    # The stated items meet all blocks, a bundle of them at a time.
    used = F.broadcast(plan.agg(F.array_sort(F.collect_set("bundle")).alias("bundles")))  # one row: item_id / BUNDLE_ITEMS numbers
    blocks = heads.select("block", F.col("docs").alias("ids"), "lengths")
    left = blocks.join(used).select("*", F.explode("bundles").alias("bundle")).drop("bundles")
    # A new name for the block keeps the two sides of the cogroup apart.
    postings = rows.where(F.col("term").isNotNull()).select(F.col("block").alias("at"), "term", "docs", "tfs")
    none = F.lit(None).cast("binary")
    carried = left.select("*", none.alias("items"), none.alias("places"), none.alias("scores"))
    sure = plan.select("item_id", F.lit(0).cast("long").alias("sure"))
    for owner in owners:
        rest = sum((F.col(str(o)) for o in owners[owner:]), F.lit(0)).cast("long")
        states = plan.join(sure, "item_id").select("bundle", F.struct("item_id", "sure", rest.alias("rest")).alias("ask"))
        states = states.groupBy("bundle").agg(F.sort_array(F.collect_list("ask")).alias("asked"))
        uses = terms.where(F.col("owner") == owner).groupBy("term", "bundle", "w").agg(F.collect_list("item_id").alias("items"))
        right = scale.sized_join(postings, uses, ["term"], F.col("at")).drop("term")
        met = carried.join(states, "bundle").groupBy("block", "bundle").cogroup(right.groupBy("at", "bundle"))
        last = owner == owners[-1]
        bundles = staged(met.applyInArrow(_bundles(n_docs, n_terms, last, top), BEST if last else BUNDLE), f"bundles-{owner}")
        if not last:
            sure = staged(_sure(bundles, plan, top), "sure")
            carried = left.join(bundles, ["block", "bundle"])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = bundles.select("item_id", "doc_id", "score", F.row_number().over(order).alias("rank"))
    return out.where((F.col("rank") <= top) & (F.col("score") > 0)).select("item_id", "rank", "doc_id", "score")
