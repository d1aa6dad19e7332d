"""Time the headline queries and print one JSON line.

Each query is built and its whole result written to the no-op sink, so every row
and column is computed but nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from covaria.operators.scale import clean
from covaria.plans.catalogue import QUERIES

HEADLINE = [
    "cohort_notes_join",
    "normalise_nltk",
    "unigram_counts",
    "top_bigrams",
    "presence_empi_expdate",
    "presence_bigram",
    "presence_substring",
    "code_frequency_combined",
    "clean_delimiters",
    "term_frequency",
    "participant_modes",
    "module_summary",
    "cluster_sets",
    "assign_clusters",
    "fit_clusters",
    "bag_of_words",
    "topic_max_pool",
    "coherence_umass",
    "coherence_npmi",
    "coherence_cv",
    "fit_topics",
    "embed_word2vec",
    "covariates_sparse",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("covaria-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/customer.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clean(spark)
        print(name, seconds[name], file=sys.stderr)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
