"""Writers of features, matrices, models and reports, and reuse of finished results."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.functions import parse as P
from covaria.operators import scale
from covaria.sources import schemas as S
from covaria.sources import wide

# Rows per file of sentence and word embeddings.
SENTENCE_ROWS = 1_000
WORD_ROWS = 200_000


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``rows`` has, in place of what they held; others stay."""
    files = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    files.partitionBy(*by).parquet(path)


def write_notes(notes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    notes.write.mode(mode).parquet(path)


def write_note_extract(notes: DataFrame, path: str) -> None:
    """Notes as the quoted CSV extract that ``read_notes`` reads."""
    (
        notes.select(*S.NOTES.names)
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("overwrite")
        .csv(path)
    )


def write_ngram_features(presence: DataFrame, path: str, n: int, csv_path: str | None = None) -> None:
    """Long features with their span, one partition per n; optional CSV copy."""
    _replace(presence.withColumn("n", F.lit(n)), path, "n")
    if csv_path is not None:
        presence.write.mode("overwrite").option("header", True).csv(f"{csv_path}/{n}gram")


def write_ngram_shards(
    features: DataFrame, vocabulary: DataFrame, path: str, stem: str = "unigram", width: int = 1000
) -> None:
    """The whole n-gram matrix as wide shards ``unigram_1.csv`` and so on, most frequent n-grams first."""
    named = vocabulary.withColumnRenamed("ngram", "feature")
    ranked = scale.numbered(
        named.withColumn("_all", F.lit(0)), ["_all"], [F.col("n").desc(), F.col("feature")], "rank", 1
    )
    keyed = features.select(
        K.empi_indexdt(F.col("empi"), F.col("expdate")).alias(wide.KEY), "feature", "value"
    )
    wide.write_blocks(keyed, ranked.select("feature", "rank"), path, stem, width=width)


def write_topic_contributions(rows: DataFrame, path: str, k: int) -> None:
    """Topic lists as parquet, one partition per topic count."""
    _replace(rows.withColumn("k", F.lit(k)), path, "k")


def write_topic_strings(rows: DataFrame, path: str) -> None:
    """Topic lists in text form, pipe-delimited with six named columns."""
    rows.select(
        "empi",
        "expdate",
        "notedate",
        F.abs("days").alias("diff"),
        "notetype",
        P.topic_text(F.col("topic_contributions")).alias("topic_contributions"),
    ).write.mode("overwrite").option("header", True).option("sep", "|").csv(path)


def write_topic_lines(rows: DataFrame, path: str) -> None:
    """The same fields of a note joined without separator, one text line each."""
    line = F.concat(
        "empi",
        F.col("expdate").cast("string"),
        F.col("notedate").cast("string"),
        F.abs("days").cast("string"),
        "notetype",
        P.topic_text(F.col("topic_contributions")),
    )
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_embeddings(
    rows: DataFrame, path: str, rows_per_file: int = SENTENCE_ROWS, by: Sequence[str] = ()
) -> None:
    files = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    files.partitionBy(*by).parquet(path)


def write_cluster_sets(sets: DataFrame, path: str, level: str, model: str, k: int) -> None:
    named = sets.withColumns({"level": F.lit(level), "model": F.lit(model), "k": F.lit(k)})
    _replace(named, path, "level", "model", "k")


def write_mterms(frequency: DataFrame, binary: DataFrame, path: str) -> None:
    """Long frequency and binary tables, one partition per feature kind."""
    frequency.write.mode("overwrite").partitionBy("family").parquet(f"{path}/frequency")
    binary.write.mode("overwrite").partitionBy("family").parquet(f"{path}/binary")


def write_topic_matrices(
    raw: DataFrame, pooled: DataFrame, binary: DataFrame, path: str, k: int
) -> None:
    """Per-note, max-pooled and binarised matrices of one topic count."""
    raw.write.mode("overwrite").parquet(f"{path}/k={k}/raw_unlisted")
    pooled.write.mode("overwrite").parquet(f"{path}/k={k}/max_pooled")
    binary.write.mode("overwrite").parquet(f"{path}/k={k}/binarized")


def write_topic_reports(
    ranked: DataFrame, terms: DataFrame, metrics: DataFrame, path: str
) -> None:
    """Topics by coherence, topic words with weights, and topic metrics, as tables."""
    ranked.write.mode("overwrite").parquet(f"{path}/topics")
    terms.write.mode("overwrite").parquet(f"{path}/topic_terms")
    metrics.write.mode("overwrite").parquet(f"{path}/topic_metrics")


def finished(spark: SparkSession, path: str) -> bool:
    """Has a job written ``path`` to its end?"""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def input_digest(rows: DataFrame) -> str:
    """Number of rows and the sums of both halves of their MD5 hashes: the same in any order of the rows."""
    shown = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).cast("binary"))
    half = lambda at: F.sum(F.conv(F.substring(shown, at, 16), 16, 10).cast("decimal(38,0)"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), half(1).alias("high"), half(17).alias("low")).first()
    return f"{','.join(sorted(rows.columns))}:{found['n']}:{found['high']}:{found['low']}"


def _stamp(inputs: Sequence[DataFrame], settings: dict | None) -> str:
    return json.dumps({"settings": settings or {}, "inputs": [input_digest(i) for i in inputs]}, sort_keys=True)


def _current(spark: SparkSession, path: str, stamp: str) -> bool:
    """Was the result at ``path`` made from these inputs and settings?"""
    note = f"{path}.inputs"
    return finished(spark, note) and [r["value"] for r in spark.read.text(note).collect()] == [stamp]


def _note(spark: SparkSession, path: str, stamp: str) -> None:
    """Written after the result, so a job that dies in between is done again."""
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.inputs")


def reused(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: Sequence[DataFrame] = (),
    settings: dict | None = None,
) -> DataFrame:
    """Read a finished table, or build and write it first.

    With ``inputs`` or ``settings`` the table is read only if it was made from the same rows,
    in any order, and the same settings; else it is built again in its place.
    """
    stamp = _stamp(inputs, settings)
    keyed = bool(inputs or settings)
    if not finished(spark, path) or (keyed and not _current(spark, path, stamp)):
        build().write.mode("overwrite").parquet(path)
        _note(spark, path, stamp)
    return spark.read.parquet(path)


def reused_model(
    spark: SparkSession,
    path: str,
    kind,
    fit: Callable[[], object],
    inputs: Sequence[DataFrame] = (),
    settings: dict | None = None,
):
    """Load a saved model of class ``kind``, or fit and save it; ``inputs`` and ``settings`` as in ``reused``."""
    stamp = _stamp(inputs, settings)
    keyed = bool(inputs or settings)
    if not finished(spark, f"{path}/data") or (keyed and not _current(spark, path, stamp)):
        fit().write().overwrite().save(path)
        _note(spark, path, stamp)
    return kind.load(path)


def write_cluster_report(stats: DataFrame, sample: DataFrame, path: str, k: int) -> None:
    """Text samples and sizes of each cluster, one folder per cluster count."""
    stats.write.mode("overwrite").parquet(f"{path}/k={k}/stats")
    sample.write.mode("overwrite").parquet(f"{path}/k={k}/sample")
