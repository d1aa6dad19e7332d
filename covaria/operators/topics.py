"""Topic models: vocabulary, fit, contributions, and participant matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import parse as P
from covaria.functions import text as X
from covaria.operators import scale

NOTE_KEYS = ("note_id", "empi", "expdate", "notedate", "notetype", "days")
# Vocabulary limits, weight floor and learning rate.
NO_BELOW = 20
NO_ABOVE = 0.45
KEEP_TERMS = 100_000
MIN_WEIGHT = 0.01
LEARNING_OFFSET = 1.0
LEARNING_DECAY = 0.5


def topic_tokens(
    notes: DataFrame, stop_words: Sequence[str] = X.ENGLISH_STOP_WORDS
) -> DataFrame:
    """Windowed notes as lists of topic-model tokens."""
    return notes.select(*NOTE_KEYS, X.topic_tokens(F.col("text"), stop_words).alias("tokens"))


def document_frequency(
    tokens: DataFrame,
    no_below: int = NO_BELOW,
    no_above: float = NO_ABOVE,
    keep: int = KEEP_TERMS,
) -> DataFrame:
    """Terms in at least ``no_below`` notes and at most that share; the ``keep`` widest spread."""
    notes = tokens.agg(F.count(F.lit(1)).alias("n")).scalar()
    each = scale.exploded(tokens, [], F.array_distinct("tokens"), "term")
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("notes"))
    kept = counts.where((F.col("notes") >= no_below) & (F.col("notes") <= notes * no_above))
    return scale.largest(kept, keep, "notes", "term")


def term_counts(tokens: DataFrame) -> DataFrame:
    """Each term of a row with how often it stands there, counted as runs of the sorted tokens.

    A row is counted by itself, so no task holds the terms of all its rows.
    """
    place = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)),
    )
    # Where the runs begin, and the end of the last one.
    edges = F.when(F.size("sorted") > 0, F.concat(place, F.array(F.size("sorted"))))
    held = tokens.select("note_id", F.sort_array(F.array_compact("tokens")).alias("sorted"))
    cut = held.select("note_id", "sorted", edges.alias("edges"))
    runs = F.when(F.col("edges").isNotNull(), F.sequence(F.lit(0), F.size("edges") - 2))
    each = scale.exploded(cut, ["note_id", "sorted", "edges"], runs, "i")
    begin, end = F.get("edges", F.col("i")), F.get("edges", F.col("i") + 1)
    return each.select("note_id", F.get("sorted", begin).alias("term"), (end - begin).cast("long").alias("tf"))


def bag_of_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Term counts per note over the vocabulary; rows of one note id are added up."""
    terms = vocabulary.select("term")

    def counted(rows: DataFrame) -> DataFrame:
        return scale.sized_join(term_counts(rows), terms, ["term"], F.col("note_id"), "left_semi")

    ids = tokens.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))
    again = ids.where((F.col("n") > 1) | F.col("note_id").isNull()).select("note_id")
    again = scale.staged(again, "repeated-notes")
    if again.isEmpty():
        return counted(tokens).select("note_id", "term", "tf")
    marks = again.withColumn("again", F.lit(True))
    marked = scale.sized_join(tokens, marks, ["note_id"], F.xxhash64("tokens"), "left")
    twice = F.coalesce("again", F.col("note_id").isNull())
    once = counted(marked.where(~twice)).select("note_id", "term", "tf")
    more = counted(marked.where(twice)).groupBy("note_id", "term").agg(F.sum("tf").alias("tf"))
    return once.unionByName(more)


def vocabulary_list(vocabulary: DataFrame) -> list[str]:
    """Terms in vocabulary order; as many as ``document_frequency`` keeps at most."""
    rows = vocabulary.orderBy(F.col("notes").desc(), "term").collect()
    return [r["term"] for r in rows]


def vectorised(tokens: DataFrame, terms: Sequence[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(
        list(terms), inputCol="tokens", outputCol="features"
    )
    return model.transform(tokens)


@contextmanager
def held(vectors: DataFrame) -> Iterator[DataFrame]:
    """The features, kept on the executors for several passes; kept ones are given back as they are."""
    if vectors.is_cached:
        yield vectors
        return
    kept = vectors.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_topics(
    vectors: DataFrame,
    k: int,
    passes: int = 10,
    seed: int = 0,
    batch_share: float = 0.5,
    optimizer: str = "online",
    iterations: int = 50,
) -> LocalLDAModel:
    """LDA by one of Spark's optimisers; no argument depends on the number of notes.

    ``online`` runs ``passes / batch_share`` steps, each on a random ``batch_share`` of the
    notes drawn with replacement, so a note is left out of all of them with a chance of
    about e^-passes (1 in 22,000 at 10). ``em`` reads every note in each of ``iterations``
    steps; its model is made local for use and saving.
    """
    lda = LDA(k=k, seed=seed, featuresCol="features", optimizer=optimizer)
    if optimizer == "online":
        lda = lda.setMaxIter(math.ceil(passes / batch_share)).setSubsamplingRate(batch_share)
        lda = lda.setLearningOffset(LEARNING_OFFSET).setLearningDecay(LEARNING_DECAY)
        lda = lda.setOptimizeDocConcentration(False)
    else:
        lda = lda.setMaxIter(iterations)
    with held(vectors) as kept:
        model = lda.fit(kept)
        return model.toLocal() if model.isDistributed() else model


def contributions(model: LDAModel, vectors: DataFrame, floor: float = MIN_WEIGHT) -> DataFrame:
    """Topics of each note with at least the floor weight, heaviest first."""
    weights = vector_to_array("topicDistribution")
    pairs = F.transform(
        weights, lambda w, i: F.struct(i.alias("topic"), w.alias("weight"))
    )
    kept = F.filter(pairs, lambda t: t["weight"] >= floor)
    return model.transform(vectors).select(
        *NOTE_KEYS, P.heaviest_first(kept).alias("topic_contributions")
    )


def topic_terms(model: LDAModel, terms: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` heaviest terms of each topic; vocabulary and topics are both bounded."""
    spark = model.describeTopics(1).sparkSession
    names = spark.createDataFrame(list(enumerate(terms)), "id int, term string")
    pairs = F.arrays_zip(F.col("termIndices").alias("id"), F.col("termWeights").alias("weight"))
    heavy = model.describeTopics(n).select("topic", F.posexplode(pairs).alias("pos", "pair"))
    listed = heavy.select("topic", (F.col("pos") + 1).alias("rank"), "pair.id", "pair.weight")
    return listed.join(names, "id").select("topic", "rank", "term", "weight")


def log_perplexity(model: LDAModel, vectors: DataFrame) -> float:
    """Per-word bound of the notes; larger is better, as a log-likelihood."""
    with held(vectors) as kept:  # words are counted by a pass of their own
        return -model.logPerplexity(kept)


def unnested(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per note and topic, without notes that have an empty list.

    The list is not asked for its size: that test would move below it, and a model would be
    asked again for the topics of each note.
    """
    each = rows.select(*keys, F.posexplode_outer("topic_contributions").alias("pos", "pair"))
    return each.where(F.col("pos").isNotNull()).select(*keys, "pair.*")


def topic_pivot(rows: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Note × topic weights, 0 where a note lacks the topic.

    A note is one row already, so its columns are read from its own list.
    """
    full = rows.where(F.size("topic_contributions") > 0)
    by_topic = F.map_from_entries("topic_contributions")
    mapped = full.select(*keys, by_topic.alias("weights"))
    cells = [
        F.coalesce(F.try_element_at("weights", F.lit(i)), F.lit(0.0)).alias(
            f"topic_contributions_{i}"
        )
        for i in range(k)
    ]
    return mapped.select(*keys, *cells)


def max_pooled(rows: DataFrame, keys: Sequence[str] = ("empi",)) -> DataFrame:
    """Largest weight of each topic over a participant's notes, long form."""
    each = unnested(rows, [*keys])
    return each.groupBy(*keys, "topic").agg(F.max("weight").alias("weight"))


def max_pool_matrix(cohort: DataFrame, rows: DataFrame, k: int, key: str = "empi") -> DataFrame:
    """Cohort × topic weights; participants without a topic get 0."""
    pooled = max_pooled(rows, [key])
    named = pooled.withColumn("topic", F.concat(F.lit("topic_contributions_"), F.col("topic")))
    names = [f"topic_contributions_{i}" for i in range(k)]
    matrix = named.groupBy(key).pivot("topic", names).agg(F.first("weight"))
    return cohort.join(matrix, key, "left").fillna(0.0, subset=names)


def binary_matrix(matrix: DataFrame) -> DataFrame:
    """1 where a topic weight is not zero."""
    return matrix.select(
        *[
            (F.col(c) != 0).cast("int").alias(c) if c.startswith("topic_contributions_") else c
            for c in matrix.columns
        ]
    )


def as_features(rows: DataFrame) -> DataFrame:
    pooled = max_pooled(rows, ["empi", "expdate"])
    return pooled.select(
        "empi",
        "expdate",
        F.lit("topic").alias("family"),
        F.concat(F.lit("topic_contributions_"), F.col("topic")).alias("feature"),
        F.col("weight").alias("value"),
    )
