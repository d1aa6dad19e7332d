"""Cohort, notes, events, mentions and vectors derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import scale


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Index date = last order; washout flags from the customer number."""
    last = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_orderdate").alias("last_order"))
    )
    joined = table(spark, folder, "customer").join(last, "c_custkey")
    number = F.col("c_custkey")

    def every(n: int, name: str):
        return F.when(number % n == 0, 1).otherwise(0).alias(name)

    return joined.select(
        number.cast("string").alias("empi"),
        F.to_date("last_order").alias("expdate"),
        number.cast("string").alias("p_id"),
        F.when(F.col("c_acctbal") > 0, "1").otherwise("0").alias("outcome"),
        every(5, "prior365_treatment_flag"),
        every(7, "prior365_comparator_flag"),
        every(10, "prior180_treatment_flag"),
        every(14, "prior180_comparator_flag"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as notes of a hundred patients, around their index date."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    owned = scale.spread(documents, "doc_id").withColumn(
        "empi", (F.col("doc_id") % 100).cast("string")
    )
    members = cohort(spark, folder).select("empi", "expdate", "p_id", "outcome")
    joined = scale.sized_join(owned, members, ["empi"], F.col("doc_id"))
    offset = (30 - (F.col("doc_id") * 19) % 400).cast("int")
    return joined.select(
        F.col("doc_id").alias("note_id"),
        "p_id",
        "expdate",
        "empi",
        "outcome",
        F.col("source").alias("notetype"),
        F.date_add("expdate", offset).alias("notedate"),
        "text",
    )


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").repartition("l_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        parts, lines["l_partkey"] == parts["p_partkey"]
    )


def code_events(spark: SparkSession, folder: str) -> DataFrame:
    return _order_lines(spark, folder).select(
        F.col("o_custkey").cast("string").alias("empi"),
        F.to_date("l_shipdate").alias("event_date"),
        F.col("p_brand").alias("code"),
        F.when(F.col("l_linenumber") % 3 == 0, "rpdr").otherwise("mcr").alias("source"),
    )


def mterms(spark: SparkSession, folder: str) -> DataFrame:
    """Term mentions with five modules, null flags and empty concept codes."""
    members = cohort(spark, folder).select("empi", "expdate")
    lines = _order_lines(spark, folder).withColumn("empi", F.col("o_custkey").cast("string"))
    joined = scale.sized_join(lines, members, ["empi"], F.col("l_orderkey"))
    size = F.col("p_size").cast("string")
    kind = F.col("l_linenumber") % 5
    module = (
        F.when(kind == 0, "ade")
        .when(kind == 1, "Allergy")
        .when(kind == 2, "Medication")
        .when(kind == 3, "Problem")
        .otherwise("Other")
    )
    negated = F.when(kind == 4, F.lit(None)).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    family = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 1).otherwise(0)
    return joined.select(
        F.col("o_custkey").alias("key"),
        F.col("l_orderkey").alias("noteID"),
        "expdate",
        F.to_date("l_shipdate").alias("notedate"),
        module.alias("module"),
        F.concat("p_type", F.lit(" "), size, F.lit(".5")).alias("term"),
        negated.alias("negated_mod"),
        family.alias("family_history_mod"),
        F.concat(F.lit("M"), size).alias("concept_id"),
        F.concat(F.lit("S "), "p_brand").alias("SNOMED_PrefTerm"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(size).alias("rxcui"),
        F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("UMLS_CUI"),
    )


def _owned_vectors(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (number % 100).cast("string").alias("empi"),
        F.concat(F.lit("sentence "), (number % 60).cast("string")).alias("document"),
        "embedding",
        "label",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _owned_vectors(spark, folder).drop("label")


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _owned_vectors(spark, folder).drop("embedding")
    return rows.withColumnRenamed("label", "cluster")


def topic_strings(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    shown = F.concat(
        F.lit("[("),
        label.cast("string"),
        F.lit(", 0.625), ("),
        ((label + 3) % 10).cast("string"),
        F.lit(", 0.25)]"),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("note_id"),
        (F.col("vec_id") % 100).cast("string").alias("empi"),
        F.when(F.col("vec_id") % 9 == 0, "[]").otherwise(shown).alias("topic_contributions"),
    )
