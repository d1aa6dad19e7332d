"""The corpus pipeline: stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm import contamination, copies, mixture, personal, toxicity
from covaria.llm.queries import WEIGHTS, domain_of
from covaria.llm.tables import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``rejected``; a null doc_id stays."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from ``labels`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fitted(table(spark, sf_dir, "documents"), labels)
    scores = toxicity.scored(docs, model, kept=COLUMNS)
    return scores.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts stays: that of the smallest doc_id which holds one.

    Texts are classed by themselves, not by doc_id: the texts of a repeated doc_id are not
    tied together, and each stays unless its own class has a row elsewhere. Null texts and
    those without words are copies of nothing but equal rows of their doc_id.
    """
    # A key for each doc_id and text; null texts have keys of their own.
    marked = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("key"))
    # Two texts may share a key by chance; they would be in one class, and the digest keeps both rows.
    marked = marked.withColumn("digest", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary")))
    named = marked.where(F.col("doc_id").isNotNull())
    classes = copies.near_duplicates(named.select(F.col("key").alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("key"), "class_id").distinct()
    held = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    heads = held.join(classes, "key").groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    heads = staged(heads.select("head.key"), "heads")
    # One shuffle of the texts, by key, serves the join and the choice among equal rows.
    kept = named.join(heads.hint("merge"), "key", "left_semi")
    first = kept.groupBy("key", "digest").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    unnamed = docs.where(F.col("doc_id").isNull()).select(*COLUMNS)
    return first.select("row.*").select(*COLUMNS).unionByName(unnamed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without(docs, contamination.contained(docs, table(spark, sf_dir, "benchmark")))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text becomes a mark of its kind."""
    return personal.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture, one row for each epoch that takes them."""
    domain = domain_of(F.col("source"))
    return mixture.mixed(docs, WEIGHTS, domain, 0.8, 2, kept=("text", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("contamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("mixture", mix_sources),
]

# Scores, signatures and local parsers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written and reread for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
