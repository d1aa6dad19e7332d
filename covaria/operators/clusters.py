"""Embedding clusters: fit, assign, and per-participant cluster sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Cluster counts of the default sweep, and rows kept per sample.
CLUSTER_COUNTS = (500, 1000, 2000, 5000, 10000)
SAMPLE_TEXTS = 20
BLOCK_ROWS = 256
CENTRE_ROWS = 64
# Spark's defaults of K-means.
SWEEP_STEPS = 20
SWEEP_TOLERANCE = 1e-4
MOST_CENTRES = 100_000


def with_vector(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Drop rows without an embedding and add the ML vector."""
    present = rows.where(F.col(column).isNotNull())
    return present.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def fit_clusters(
    rows: DataFrame, k: int, seed: int = 0, max_iter: int = 20, init_mode: str = "k-means||"
) -> KMeansModel:
    """K-means over all vectors; use ``init_mode='random'`` for thousands of clusters."""
    means = KMeans(k=k, seed=seed, maxIter=max_iter, initMode=init_mode)
    return means.fit(with_vector(rows).select("features"))


def predicted(model: KMeansModel, rows: DataFrame) -> DataFrame:
    out = model.setPredictionCol("cluster").transform(with_vector(rows))
    return out.drop("features")


def label_centres(rows: DataFrame, label: str, digits: int = 3) -> DataFrame:
    """Mean vector of each label, rounded."""
    mean = Summarizer.mean(F.col("features"))
    means = with_vector(rows).groupBy(label).agg(vector_to_array(mean).alias("centre"))
    rounded = F.transform("centre", lambda x: F.round(x, digits))
    return means.select(F.col(label).alias("cluster"), rounded.alias("centre"))


def _nearest(ids: np.ndarray, centres: np.ndarray):
    """Arrow-batched nearest centre; blocks keep the distance matrix small."""
    norms = (centres**2).sum(axis=1)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.empty(len(batch), dtype="int32")
            for lo in range(0, len(batch), BLOCK_ROWS):
                block = np.stack(batch.iloc[lo : lo + BLOCK_ROWS].to_numpy()).astype("float64")
                gaps = norms - 2.0 * (block @ centres.T)
                found[lo : lo + len(block)] = ids[gaps.argmin(axis=1)]
            yield pd.Series(found)

    return nearest


def assign_clusters(rows: DataFrame, centres: DataFrame, column: str = "embedding") -> DataFrame:
    """Nearest of the given centres, which pass through the driver: at most ``MOST_CENTRES``."""
    listed = centres.orderBy("cluster").limit(MOST_CENTRES + 1).collect()
    if len(listed) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    ids = np.array([r["cluster"] for r in listed], dtype="int32")
    points = np.array([r["centre"] for r in listed], dtype="float64")
    present = rows.where(F.col(column).isNotNull())
    return present.withColumn("cluster", _nearest(ids, points)(F.col(column)))


def centre_table(spark, centres: Sequence[np.ndarray]) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def _summed(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per nearest centre, the number of a task's vectors, their squared distances and their sum."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (centres**2).sum(axis=1)
        n, cost, sums = np.zeros(len(centres), "int64"), np.zeros(len(centres)), np.zeros_like(centres)
        for batch in batches:
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for lo in range(0, len(points), CENTRE_ROWS):
                block = points[lo : lo + CENTRE_ROWS]
                gaps = block @ centres.T
                gaps *= -2.0
                gaps += norms
                near = gaps.argmin(axis=1)
                np.add.at(n, near, 1)
                np.add.at(cost, near, ((block - centres[near]) ** 2).sum(axis=1))
                np.add.at(sums, near, block)
        used = np.flatnonzero(n)
        yield _sums(used, n[used], cost[used], sums[used])

    return summed


def _sums(cluster: np.ndarray, n: np.ndarray, cost: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(cluster) + 1) * (sums.shape[1] if len(cluster) else 0)
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.ravel(), pa.float64()))
    columns = [pa.array(cluster, pa.int32()), pa.array(n, pa.int64()), pa.array(cost, pa.float64()), listed]
    return pa.RecordBatch.from_arrays(columns, ["cluster", "n", "cost", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cluster as one; all rows of a cluster are in one task."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    cells = pa.Table.from_batches(rows).combine_chunks()
    numbers, cost = (cells.column(c).to_numpy() for c in ("n", "cost"))
    sums = cells.column("sums").combine_chunks().flatten().to_numpy().reshape(len(numbers), -1)
    used, place = np.unique(cells.column("cluster").to_numpy(), return_inverse=True)
    n, costs, total = np.zeros(len(used), "int64"), np.zeros(len(used)), np.zeros((len(used), sums.shape[1]))
    np.add.at(n, place, numbers)
    np.add.at(costs, place, cost)
    np.add.at(total, place, sums)
    yield _sums(used, n, costs, total)


def _moved(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """One step of K-means: the means of the vectors of each centre, and their cost before it.

    A centre without vectors stays. Tasks send one row per centre, added up by centre.
    """
    kinds = "cluster int, n long, cost double, sums array<double>"
    parts = points.mapInArrow(_summed(centres), kinds).repartition("cluster")
    held = parts.mapInArrow(_added, kinds).toArrow()
    used = held.column("cluster").to_numpy()
    means = centres.copy()
    sums = held.column("sums").combine_chunks().flatten().to_numpy().reshape(len(used), -1)
    means[used] = sums / held.column("n").to_numpy()[:, None]
    return means, float(held.column("cost").to_numpy().sum())


def cluster_sweep(rows: DataFrame, counts: Sequence[int] = CLUSTER_COUNTS, seed: int = 0) -> DataFrame:
    """Training cost per cluster count, every fit reading one cached set of vectors.

    Counts above the number of vectors are left out: there are no such clusters. Spark's K-means
    draws the first centres; its steps and its end are as Spark has them, over all cores and by
    matrix products, for Spark keeps as many tasks as the files have.
    """
    spark = rows.sparkSession
    vectors = with_vector(rows).select("embedding", "features").persist()
    points = vectors.select(F.col("embedding").cast("array<double>").alias("x"))
    points = points.repartition(2 * spark.sparkContext.defaultParallelism).persist()
    try:
        costs, most = [], vectors.count()
        for k in (k for k in counts if k <= most):
            drawn = KMeans(k=k, seed=seed, initMode="random", maxIter=0).fit(vectors.select("features"))
            centres, cost = np.array(drawn.clusterCenters()), 0.0
            for _ in range(SWEEP_STEPS):
                before = centres
                centres, cost = _moved(points, before)
                if ((centres - before) ** 2).sum(axis=1).max() <= SWEEP_TOLERANCE**2:
                    break
            costs.append((k, len(centres), cost))
    finally:
        points.unpersist()
        vectors.unpersist()
    return spark.createDataFrame(costs, "k int, clusters int, cost double")


def cluster_sets(labelled: DataFrame, key: str = "empi") -> DataFrame:
    """Distinct clusters per participant and how many; pairs are deduplicated first."""
    pairs = labelled.select(key, "cluster").distinct()
    sets = pairs.groupBy(key).agg(F.sort_array(F.collect_list("cluster")).alias("cluster"))
    return sets.withColumn("positive_cluster_num", F.size("cluster"))


def cluster_onehot(sets: DataFrame, k: int, key: str = "empi") -> DataFrame:
    """0/1 column per cluster id. For thousands of clusters use ``indicator_vectors``."""
    cells = [
        F.array_contains("cluster", i).cast("int").alias(f"Cluster_ID_{i}") for i in range(k)
    ]
    return sets.select(key, *cells)


def cluster_stats(labelled: DataFrame, text: str = "document") -> DataFrame:
    """Distinct texts and rows per cluster."""
    per_text = labelled.groupBy("cluster", text).agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("cluster").agg(
        F.count(text).alias("texts"), F.sum("n").alias("rows")
    )


def cluster_sample(
    labelled: DataFrame, n: int = SAMPLE_TEXTS, text: str = "document"
) -> DataFrame:
    """Up to ``n`` texts per cluster, first by name.

    Spark keeps ``n`` rows per cluster and task before it shuffles them.
    """
    texts = labelled.select("cluster", text).distinct()
    position = F.row_number().over(Window.partitionBy("cluster").orderBy(text))
    return texts.withColumn("position", position).where(F.col("position") <= n)


def as_features(labelled: DataFrame, cohort: DataFrame, family: str) -> DataFrame:
    """Long 0/1 cluster features of cohort members."""
    pairs = labelled.select("empi", "cluster").distinct()
    return pairs.join(cohort.select("empi", "expdate"), "empi").select(
        "empi",
        "expdate",
        F.lit(family).alias("family"),
        F.concat(F.lit("Cluster_ID_"), F.col("cluster").cast("string")).alias("feature"),
        F.lit(1.0).alias("value"),
    )
