"""A topic model held as tables: (topic, term, weight) and (note, topic, weight).

The model is the smoothed mixture of multinomials behind LDA, fitted by expectation and
maximisation with additive smoothing (Asuncion, Welling, Smyth and Teh 2009). A step joins the
word counts with both tables and sums the shares of the topics by note and by term, so no
matrix of topics and vocabulary is on the driver that would not fit a broadcast. Topics that fit go
to the notes: the words of a note are brought together once, and only sums by term are shuffled
and only topics kept. Beginnings come from hashes of the terms: the same counts give the same model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from covaria.operators import scale

HEX_DIGITS = "0123456789abcdef"
FEW_TOPICS = 64
MOST_CELLS = 1 << 22


def _joined(big: DataFrame, other: DataFrame, key: str, spread_by: Column, fits: bool) -> DataFrame:
    if fits:
        return big.join(F.broadcast(other), key)
    return scale.salted_join(big, other, [key], spread_by)


def _named(name: str, k: int) -> list[str]:
    return [f"_{name}{i}" for i in range(k)]


def _added(values: list[Column]) -> Column:
    """The sum from left to right; of many topics by a loop, as a long sum is a deep expression."""
    if len(values) <= FEW_TOPICS:
        return reduce(lambda a, x: a + x, values)
    return F.aggregate(F.array(*values), F.lit(0.0), lambda a, x: a + x)


def _summed(shares: DataFrame, key: str, k: int) -> DataFrame:
    """(key, shares): the sum of each topic's shares over the rows of each key."""
    return shares.groupBy(key).agg(*[F.sum(s).alias(s) for s in _named("share", k)])


def _first_terms(terms: DataFrame, k: int) -> DataFrame:
    """(term, weights): a topic's chance of each term to begin with, from the term's hash."""
    digit = lambda i: F.instr(F.lit(HEX_DIGITS), F.substring(F.md5(F.concat("term", F.lit(f"#{i}")).cast("binary")), 1, 1))
    drawn = terms.select("term", *[digit(i).cast("double").alias(s) for i, s in enumerate(_named("share", k))])
    return _by_topic(drawn, k, 0.0)


def _by_topic(rows: DataFrame, k: int, beta: float) -> DataFrame:
    """(term, weights): sums per term, smoothed by ``beta`` and divided by the topic's total."""
    smooth = scale.staged(rows.select("term", *[(F.col(s) + beta).alias(s) for s in _named("share", k)]), "sums")
    # One row of k numbers.
    totals = smooth.agg(*[F.sum(s).alias(t) for s, t in zip(_named("share", k), _named("total", k))])
    every = smooth.join(F.broadcast(totals))
    parts = zip(_named("share", k), _named("total", k), _named("weight", k))
    return every.select("term", *[(F.col(s) / F.col(t)).alias(w) for s, t, w in parts])


def _shares(rows: DataFrame, k: int) -> DataFrame:
    """What each topic takes of a word of a note: its weight in both, scaled to the word's count."""
    products = [F.col(t) * F.col(w) for t, w in zip(_named("theta", k), _named("weight", k))]
    total = _added(products)
    shares = [(p / total * F.col("tf")).alias(s) for p, s in zip(products, _named("share", k))]
    return rows.select("note_id", "term", *shares)


def _even(bag: DataFrame, k: int) -> DataFrame:
    return bag.select("note_id").distinct().select("note_id", *[F.lit(1.0 / k).alias(t) for t in _named("theta", k)])


def _theta(sums: DataFrame, k: int, alpha: float) -> DataFrame:
    """(note_id, theta): the smoothed shares of the topics in each note."""
    smooth = [F.col(s) + alpha for s in _named("share", k)]
    total = _added(smooth)
    return sums.select("note_id", *[(x / total).alias(t) for x, t in zip(smooth, _named("theta", k))])


def _matrix(topics: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms in order, and a row of weights for each, of topics (term, weights) that fit a broadcast."""
    rows = topics.where(F.col("term").isNotNull() & F.col("weights").isNotNull()).orderBy("term").toArrow()
    cells = rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("term").to_pylist(), cells.reshape(rows.num_rows, -1)


def note_words(bag: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(note_id, ids, tf): the words of each note that are among ``terms``, as places in that list.

    Places are shuffled and not words. Notes without such a word have no row.
    """
    places = pa.table({"term": pa.array(terms, pa.string()), "id": pa.array(range(len(terms)), pa.int32())})
    known = F.broadcast(bag.sparkSession.createDataFrame(places))
    met = bag.join(known, "term").select("note_id", F.struct("id", F.col("tf").cast("double").alias("tf")).alias("word"))
    held = met.groupBy("note_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return held.select("note_id", F.col("words.id").alias("ids"), F.col("words.tf").alias("tf"))


def _blocks(ids: pa.Array, tf: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, starts, ids, tf) of the notes of a batch, together while their words and topics make up ``MOST_CELLS``."""
    places, counts = ids.flatten().to_numpy(), tf.flatten().to_numpy()
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))
    cuts = np.flatnonzero(np.diff(starts[:-1] // max(1, MOST_CELLS // k))) + 1
    for first, last in pairwise([0, *cuts.tolist(), len(ids)]):
        at, end = starts[first], starts[last]
        yield first, last, starts[first:last] - at, places[at:end], counts[at:end]


def _note_shares(theta: np.ndarray, weights: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each topic takes of the words of the notes that begin at ``starts``."""
    product = np.repeat(theta, np.diff(np.append(starts, len(tf))), axis=0)
    product *= weights
    product *= (tf / product.sum(axis=1))[:, None]
    return product


def _fold(tf: np.ndarray, weights: Sequence[np.ndarray], starts: np.ndarray, k: int, alpha: float) -> np.ndarray:
    """Topics of the notes whose words begin at ``starts``, after a step with each of the ``weights`` of the words."""
    theta = np.full((len(starts), k), 1.0 / k)
    with np.errstate(divide="raise", invalid="raise"):
        for each in weights:
            sums = np.add.reduceat(_note_shares(theta, each, tf, starts), starts, axis=0) + alpha
            theta = sums / sums.sum(axis=1, keepdims=True)
    return theta


def _term_sums(tables: list[np.ndarray], alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per term of a task's notes, the shares of the topics by the last table, after steps with those before it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, k = tables[-1].shape
        sums, met = np.zeros((size, k)), np.zeros(size, bool)
        for batch in batches:
            for _, _, starts, ids, tf in _blocks(*batch.columns, k):
                theta = _fold(tf, [t[ids] for t in tables[:-1]], starts, k, alpha)
                with np.errstate(divide="raise", invalid="raise"):
                    shares = _note_shares(theta, tables[-1][ids], tf, starts)
                for i in range(k):
                    sums[:, i] += np.bincount(ids, shares[:, i], size)
                met[ids] = True
        used = np.flatnonzero(met)
        cells = [pa.array(np.ascontiguousarray(sums[used, i])) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *cells], ["id", *_named("share", k)])

    return summed


def _folded(words: DataFrame, tables: list[np.ndarray], k: int, alpha: float) -> DataFrame:
    """(note_id, theta) of note words after a step with each of the tables."""
    shape = T.StructType([words.schema["note_id"], T.StructField("theta", T.ArrayType(T.DoubleType()))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notes, ids, tf = batch.columns
            theta = np.empty((len(notes), k))
            for first, last, starts, places, counts in _blocks(ids, tf, k):
                once = {id(t): t[places] for t in tables}
                theta[first:last] = _fold(counts, [once[id(t)] for t in tables], starts, k, alpha)
            rows = pa.ListArray.from_arrays(np.arange(0, theta.size + 1, k, dtype=np.int32), theta.ravel())
            yield pa.RecordBatch.from_arrays([notes, rows], ["note_id", "theta"])

    return words.mapInArrow(folded, shape)


def _fit_in_notes(
    bag: DataFrame, begun: DataFrame, k: int, steps: int, alpha: float, beta: float
) -> tuple[DataFrame, DataFrame]:
    """``fit`` for topics that fit a broadcast. The topics of a note follow from those of the terms in all steps
    before, and are made again inside the note: no table of notes is joined or written before the end."""
    spark = bag.sparkSession
    terms, table = _matrix(begun)
    words = scale.staged(note_words(bag.where(F.col("note_id").isNotNull()), terms), "note-words")
    shape = ", ".join(["id int", *[f"{s} double" for s in _named("share", k)]])
    tables, met = [table], np.arange(len(terms))
    for _ in range(steps):
        sums = words.select("ids", "tf").mapInArrow(_term_sums(tables, alpha), shape)
        held = sums.groupBy("id").agg(*[F.sum(s).alias(s) for s in _named("share", k)]).toArrow()
        met = held.column("id").to_numpy()
        smooth = np.zeros(table.shape)
        smooth[met] = np.stack([held.column(s).to_numpy() for s in _named("share", k)], axis=1) + beta
        tables.append(smooth / smooth.sum(axis=0) if len(met) else smooth)
    weights = tables[-1][met]
    listed = pa.ListArray.from_arrays(np.arange(0, weights.size + 1, k, dtype=np.int32), weights.ravel())
    topics = pa.table({"term": pa.array(terms, pa.string()).take(pa.array(met)), "weights": listed})
    notes = scale.staged(_folded(words, tables[:steps], k, alpha), "notes")
    return scale.staged(spark.createDataFrame(topics), "topics"), notes


def fit(bag: DataFrame, k: int, steps: int = 20, alpha: float | None = None, beta: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Topics (term, weights) and notes (note_id, theta) after ``steps`` steps over ``bag`` (note_id, term, tf).

    While the topics of all steps fit a broadcast, notes are folded where their words are. Else topics are
    columns, whose sums Spark compiles, and the words of a note lie together, so that a task sums them
    before they are shuffled.
    """
    alpha = 1.0 / k if alpha is None else alpha
    bag = bag.select("note_id", "term", F.col("tf").cast("double").alias("tf"))
    begun = scale.staged(_first_terms(bag.select("term").distinct(), k), "topics")
    held = lambda rows, key, name, kept: rows.select(key, F.array(*_named(name, k)).alias(kept))
    if scale.small(begun, scale.BROADCAST_BYTES // max(1, steps)):
        return _fit_in_notes(bag, held(begun, "term", "weight", "weights"), k, steps, alpha, beta)
    bag = scale.staged(bag.repartition("note_id"), "bag")
    topics, notes = begun, scale.staged(_even(bag, k), "notes")
    # The tables keep their sizes, so one check serves all steps.
    few_terms, few_notes = scale.small(topics), scale.small(notes)
    for _ in range(steps):
        met = _joined(_joined(bag, topics, "term", F.col("note_id"), few_terms), notes, "note_id", F.col("term"), few_notes)
        shares = _shares(met, k)
        # Broadcast joins cost less twice than the shares take on disk; shuffles are made once.
        if not (few_terms and few_notes):
            shares = scale.staged(shares, "shares")
        topics = scale.staged(_by_topic(_summed(shares, "term", k), k, beta), "topics")
        notes = scale.staged(_theta(_summed(shares, "note_id", k), k, alpha), "notes")
    return held(topics, "term", "weight", "weights"), held(notes, "note_id", "theta", "theta")


def fold_in(bag: DataFrame, topics: DataFrame, k: int, steps: int = 20, alpha: float | None = None) -> DataFrame:
    """(note_id, theta) of notes under given topics (term, weights); unknown terms count for nothing.

    The words of a note are brought together once; the steps then go on inside the note, without a
    shuffle. Their weights come along only if the topics are too many to be sent to all notes. Notes
    without a known term have no row.
    """
    alpha = 1.0 / k if alpha is None else alpha
    if scale.small(topics):
        terms, table = _matrix(topics)
        return _folded(note_words(bag, terms), [table] * steps, k, alpha)
    counts = bag.select("note_id", "term", F.col("tf").cast("double").alias("tf"))
    met = scale.salted_join(counts, topics, ["term"], F.col("note_id"))
    held = met.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "weights"))).alias("words"))
    shape = T.StructType([held.schema["note_id"], T.StructField("theta", T.ArrayType(T.DoubleType()))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notes, tf, weights = batch.columns
            matrix = weights.flatten().flatten().to_numpy().reshape(-1, k)
            row = pa.ListArray.from_arrays(tf.offsets, pa.array(np.arange(len(matrix))))
            theta = np.empty((len(notes), k))
            for first, last, starts, rows, counts in _blocks(row, tf, k):
                theta[first:last] = _fold(counts, [matrix[rows]] * steps, starts, k, alpha)
            listed = pa.ListArray.from_arrays(np.arange(0, theta.size + 1, k, dtype=np.int32), theta.ravel())
            yield pa.RecordBatch.from_arrays([notes, listed], ["note_id", "theta"])

    return held.select("note_id", "words.tf", "words.weights").mapInArrow(folded, shape)


def top_terms(topics: DataFrame, n: int = 20) -> DataFrame:
    """(topic, rank, term, weight): the heaviest terms of each topic; weights equal to nine digits go by term."""
    cells = topics.select("term", F.posexplode("weights").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.floor(F.col("weight") * 1e9 + 0.5).desc(), "term")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("topic", "rank", "term", "weight")


def contributions(notes: DataFrame, floor: float) -> DataFrame:
    """(note_id, topic, weight) of at least the floor."""
    cells = notes.select("note_id", F.posexplode("theta").alias("topic", "weight"))
    return cells.where(F.col("weight") >= floor)


def _chances(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The log-likelihood of a task's words and their number."""

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = 0.0, 0.0
        for batch in batches:
            ids, counts, theta = batch.columns
            of = theta.flatten().to_numpy().reshape(len(theta), -1)
            for first, last, starts, places, tf in _blocks(ids, counts, table.shape[1]):
                held = np.repeat(of[first:last], np.diff(np.append(starts, len(tf))), axis=0)
                chance = (held * table[places]).sum(axis=1)
                total += float((tf * np.log(chance, where=chance > 0, out=np.zeros_like(chance))).sum())
                words += float(tf.sum())
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([words])], ["total", "n"])

    return chances


def log_perplexity(bag: DataFrame, topics: DataFrame, notes: DataFrame) -> DataFrame:
    """(bound, words): mean log-likelihood of a word under the tables; larger is better.

    Words of a note meet its topics as one row.
    """
    if scale.small(topics):
        terms, table = _matrix(topics)
        words = note_words(bag, terms)
        met = words.join(F.broadcast(notes) if scale.small(notes) else notes.hint("merge"), "note_id")
        sums = met.select("ids", "tf", "theta").mapInArrow(_chances(table), "total double, n double")
        total, n = F.sum("total"), F.sum("n")
        return sums.agg((total / n).alias("bound"), n.cast("long").alias("words"))
    met = scale.salted_join(bag, topics, ["term"], F.col("note_id"))
    met = scale.sized_join(met, notes, ["note_id"], F.col("term"))
    chance = F.aggregate(F.zip_with("theta", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    total, n = F.sum(F.col("tf") * F.log(chance)), F.sum("tf")
    return met.agg((total / n).alias("bound"), n.cast("long").alias("words"))
