"""From inputs to covariates: one function per feature family, and their union."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.ml.clustering import KMeansModel, LocalLDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.config import JobConfig
from covaria.operators import clusters, codes, coherence, embeddings, matrix, ngrams, scale, terms, topics
from covaria.operators.cohort import note_window, restrict_to_cohort
from covaria.sources import writers

# Fixed value: the name among the embeddings that asks for sentences.
SENTENCES = "sentence_detector"


def ngram_features(notes: DataFrame, config: JobConfig, sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """Presence of the top n-grams of each size, per participant and index date.

    Notes are tokenised once and staged; counting and matching are jobs on that table.
    """
    inside = note_window(notes, config.span_start, config.span_end)
    tokens = ngrams.tokenised(inside, config.preprocessor).drop("body")
    tokens = scale.staged(tokens, "tokens")
    out = None
    for n in sizes:
        chosen = None
        if not config.all_ngrams:
            chosen = ngrams.select_features(tokens, n, config.top_ngrams)
        found = ngrams.as_features(ngrams.token_presence(tokens, n, "empi_expdate", chosen), n)
        out = found if out is None else out.unionByName(found)
    return out


def ngram_tables(
    notes: DataFrame, config: JobConfig, sizes: Sequence[int] = (1, 2)
) -> dict[int, DataFrame]:
    """Presence of the top n-grams in the output layout of the settings, by n-gram size."""
    inside = note_window(notes, config.span_start, config.span_end)
    tokens = ngrams.tokenised(inside, config.preprocessor).drop("body")
    tokens = scale.staged(tokens, "tokens")
    chosen = {
        n: None if config.all_ngrams else ngrams.select_features(tokens, n, config.top_ngrams)
        for n in sizes
    }
    layout = config.key_layout()
    return {n: ngrams.token_presence(tokens, n, layout, names) for n, names in chosen.items()}


def settings_job(
    notes: DataFrame,
    config: JobConfig,
    path: str,
    models: Mapping[str, Callable[[], Callable]] | None = None,
) -> dict[str, DataFrame]:
    """Every algorithm that the settings name, written below ``path``/task and read back.

    ``ngram`` writes the presence of uni- and bigrams in the output layout of the settings;
    ``embedding`` one table of vectors for each name in ``embeddings``, made by the loader of that name
    in ``models``, of sentences when ``sentence_detector`` is among the names and else of whole
    notes; ``topic_model`` a model and the topics of each note for each topic count.
    """
    spark, root = notes.sparkSession, f"{path}/{config.task}"
    unknown = set(config.algorithm) - {"ngram", "embedding", "topic_model"}
    names = [n for n in config.embeddings if n != SENTENCES]
    lost = [n for n in names if n not in (models or {})] if "embedding" in config.algorithm else []
    if unknown or lost:
        raise ValueError(f"unknown algorithms {sorted(unknown)}, embeddings without a model {lost}")
    out = {}
    if "ngram" in config.algorithm:
        for n, rows in ngram_tables(notes, config).items():
            writers.write_ngram_features(rows, f"{root}/ngram", n)
        out["ngram"] = spark.read.parquet(f"{root}/ngram")
    if "embedding" in config.algorithm and names:
        texts = note_window(notes, config.span_start, config.span_end).select("note_id", "empi", "text")
        if SENTENCES in config.embeddings:
            texts = embeddings.sentence_rows(texts).withColumnRenamed("document", "text")
        for name in names:
            rows = embeddings.embed(texts, "text", models[name])
            writers.write_embeddings(rows, f"{root}/embedding/model={name}", writers.WORD_ROWS)
        out["embedding"] = spark.read.parquet(f"{root}/embedding")
    if "topic_model" in config.algorithm:
        for k in config.topic_counts:
            rows = topic_job(notes, config, k, f"{root}/topic")
            writers.write_topic_contributions(rows, f"{root}/contributions", k)
        out["topic_model"] = spark.read.parquet(f"{root}/contributions")
    return out


def code_features(cohort: DataFrame, events: DataFrame, dimension: str = "combined") -> DataFrame:
    return codes.as_features(codes.code_frequency(cohort, events, dimension))


def term_features(cohort: DataFrame, mentions: DataFrame) -> DataFrame:
    return terms.as_features(terms.term_frequency(cohort, mentions))


def cluster_features(cohort: DataFrame, vectors: DataFrame, k: int, family: str) -> DataFrame:
    model = clusters.fit_clusters(vectors, k)
    return clusters.as_features(clusters.predicted(model, vectors), cohort, family)


def topic_features(notes: DataFrame, config: JobConfig, k: int) -> DataFrame:
    inside = note_window(notes, config.span_start, config.span_end)
    tokens = scale.staged(topics.topic_tokens(inside), "topic-tokens")
    terms = topics.document_frequency(tokens, keep=config.keep_terms)
    vectors = topics.vectorised(tokens, topics.vocabulary_list(terms))
    model = topics.fit_topics(vectors, k, config.passes, iterations=config.iterations)
    return topics.as_features(topics.contributions(model, vectors))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def covariates(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """One row per cohort member with its sparse covariates over all families."""
    held = scale.staged(features, "features", ["family"])
    return matrix.covariate_rows(cohort, held, matrix.feature_index(held))


@dataclass(frozen=True)
class Matrices:
    """The tables of one family: long or wide, joined to the cohort."""

    frequency: DataFrame
    binary: DataFrame


def structured_codes(cohort: DataFrame, events: DataFrame, dimension: str) -> Matrices:
    """Code counts and their 0/1 form; fails on a code that two sources list."""
    return code_tables(codes.code_frequency(cohort, events, dimension))


def code_tables(frequency: DataFrame) -> Matrices:
    """Checked tables from counts (empi, expdate, source, code, n), raw or read from files."""
    frequency = scale.staged(frequency, "code-counts")
    if not codes.repeated_covariates(frequency).isEmpty():
        raise ValueError("a covariate is listed more than once")
    return Matrices(frequency, codes.checked_binary(codes.binary_codes(frequency)))


def code_matrices(cohort: DataFrame, frequency: DataFrame, dimension: str) -> Matrices:
    """Wide tables of one dimension, left-joined to the cohort: counts, and 0/1 as ``_hdec``.

    ``frequency`` may come from events or from files of counts.
    """
    chosen = frequency.where(codes.code_dimension(F.col("source"), dimension))
    tables = code_tables(chosen)
    members = cohort.select(*codes.KEYS)
    values = tables.binary.withColumnRenamed("value", "n")
    return Matrices(
        matrix.attach(members, codes.codes_wide(tables.frequency)),
        matrix.attach(members, codes.codes_wide(values)),
    )


def term_demographics(cohort: DataFrame, mentions: DataFrame) -> DataFrame:
    """Modes, module summary and missing entries, one row per cohort member."""
    inside = scale.staged(terms.of_cohort(cohort, mentions), "mentions")
    tag = terms.tagger(inside)
    present = terms.mode_columns(tag(inside))
    keys = list(terms.KEYS)
    return (
        terms.missing_summary(cohort, tag(inside))
        .join(terms.participant_modes(inside, present, tag), keys, "left")
        .join(terms.module_summary(inside, tag), keys, "left")
    )


def term_matrices(cohort: DataFrame, mentions: DataFrame, path: str | None = None) -> Matrices:
    """Frequency and 0/1 tables of terms; read back from ``path`` when already there."""
    members = cohort.select(*terms.KEYS)
    if path is None:
        frequency = terms.term_frequency(members, mentions)
    else:
        frequency = writers.reused(
            cohort.sparkSession,
            f"{path}/frequency",
            lambda: terms.term_frequency(members, mentions),
        )
    return Matrices(frequency, terms.term_binary(frequency))


def term_tables(cohort: DataFrame, mentions: DataFrame, path: str) -> Matrices:
    """Frequency and 0/1 rows joined to the demographics, saved, and read back when there.

    Demographics repeat in each row of a participant, so files are far smaller than their rows;
    what is broadcast goes by the bytes of the rows.
    """
    spark = cohort.sparkSession
    plain = term_matrices(cohort, mentions, f"{path}/terms")

    @cache
    def demographics() -> DataFrame:
        return scale.staged(term_demographics(cohort.select(*terms.KEYS), mentions), "demographics")

    def joined(rows: DataFrame) -> DataFrame:
        return scale.sized_join(rows, demographics(), list(terms.KEYS), F.xxhash64("family", "feature"))

    return Matrices(
        writers.reused(spark, f"{path}/frequency_demographics", lambda: joined(plain.frequency)),
        writers.reused(spark, f"{path}/binary_demographics", lambda: joined(plain.binary)),
    )


def topic_matrices(
    cohort: DataFrame, rows: DataFrame, k: int, key: str = "empi"
) -> tuple[DataFrame, Matrices]:
    """Per-note weights, and max-pooled and 0/1 weights per cohort member."""
    pooled = topics.max_pool_matrix(cohort, rows, k, key)
    raw = topics.topic_pivot(rows, k, ["note_id", key])
    return raw, Matrices(pooled, topics.binary_matrix(pooled))


def cluster_matrix(cohort: DataFrame, sets: DataFrame, k: int, key: str = "empi") -> DataFrame:
    """0/1 column per cluster for the cohort members that have vectors.

    For thousands of clusters take ``cluster_vectors``, which holds the ones only.
    """
    return clusters.cluster_onehot(restrict_to_cohort(sets, cohort, (key,)), k, key)


def cluster_vectors(cohort: DataFrame, sets: DataFrame, k: int, key: str = "empi") -> DataFrame:
    """The same columns as one sparse vector per cohort member."""
    inside = restrict_to_cohort(sets, cohort, (key,))
    return matrix.indicator_vectors(inside, [str(i) for i in range(k)], "cluster", "clusters")


def cluster_job(vectors: DataFrame, k: int, path: str) -> DataFrame:
    """Fit a model, or load the one of the same vectors; write sample and sizes per cluster, return cluster sets."""
    model = writers.reused_model(
        vectors.sparkSession,
        f"{path}/model/k={k}",
        KMeansModel,
        lambda: clusters.fit_clusters(vectors, k),
        [vectors],
        {"k": k},
    )
    labelled = scale.staged(clusters.predicted(model, vectors).drop("embedding"), "labels")
    writers.write_cluster_report(
        clusters.cluster_stats(labelled), clusters.cluster_sample(labelled), path, k
    )
    return clusters.cluster_sets(labelled)


def topic_metrics(tokens: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Every coherence measure per topic, and its mean as topic -1."""
    places = coherence.word_places(tokens, words)
    parts = []
    for measure in ("u_mass", "c_v", "c_uci", "c_npmi"):
        each = coherence.coherence(tokens, words, measure, places)
        each = scale.staged(each, "coherence")
        mean = coherence.average(each).select(F.lit(-1).alias("topic"), "coherence")
        both = each.select("topic", "coherence").unionByName(mean)
        parts.append(both.withColumn("metric", F.lit(measure)))
    return union(parts).select(F.lit(k).alias("k"), "metric", "topic", F.col("coherence").alias("value"))


def ranked_topics(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Topic words as one text per topic, topics in order of coherence, best first.

    The rank is a place in that order; the topic id is the one of the contributions.
    """
    scores = coherence.coherence(tokens, words, "u_mass")
    place = F.row_number().over(Window.orderBy(F.col("coherence").desc(), "topic"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "term")))
    named = words.groupBy("topic").agg(listed.alias("words"))
    return (
        scores.withColumn("topic_rank", place)
        .join(named, "topic")
        .select(
            "topic_rank", "topic", "coherence", F.array_join("words.term", ", ").alias("words")
        )
    )


def topic_job(notes: DataFrame, config: JobConfig, k: int, path: str) -> DataFrame:
    """Fit or load a topic model, write its reports, return the topics of each note.

    Vocabulary and model are loaded when they were made from the same tokens and settings, and
    made again when these have changed.
    """
    inside = note_window(notes, config.span_start, config.span_end)
    tokens = scale.staged(topics.topic_tokens(inside), "topic-tokens")
    vocabulary = writers.reused(
        notes.sparkSession,
        f"{path}/vocabulary/k={k}",
        lambda: topics.document_frequency(tokens, keep=config.keep_terms),
        [tokens.select("note_id", "tokens")],
        {"keep_terms": config.keep_terms},
    )
    terms_in_order = topics.vocabulary_list(vocabulary)
    vectors = topics.vectorised(tokens, terms_in_order)
    with topics.held(vectors) as kept:
        model = writers.reused_model(
            notes.sparkSession,
            f"{path}/model/k={k}",
            LocalLDAModel,
            lambda: topics.fit_topics(kept, k, config.passes, iterations=config.iterations),
            [tokens.select("note_id", "tokens"), vocabulary],
            {"k": k, "passes": config.passes, "iterations": config.iterations},
        )
        bound = topics.log_perplexity(model, kept)
    words = scale.staged(topics.topic_terms(model, terms_in_order, 40), "topic-words")
    perplexity = notes.sparkSession.createDataFrame(
        [(k, "log_perplexity", -1, bound)],
        "k int, metric string, topic int, value double",
    )
    metrics = topic_metrics(tokens, words, k).unionByName(perplexity)
    writers.write_topic_reports(ranked_topics(tokens, words), words, metrics, f"{path}/k={k}")
    return topics.contributions(model, vectors)
