"""From long features to one row per participant, and back.

Long form ``(empi, expdate, family, feature, value)`` is the canonical one. Wide
columns are made only for a list of features that the caller names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.operators import scale

KEYS = ("empi", "expdate")


def wide(
    features: DataFrame,
    names: Sequence[str],
    agg: Column,
    keys: Sequence[str] = KEYS,
    feature: str = "feature",
) -> DataFrame:
    """One column per listed feature."""
    return features.groupBy(*keys).pivot(feature, list(names)).agg(agg)


def long(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Back to (key, feature, value), without empty cells."""
    names = [c for c in matrix.columns if c not in keys]
    cells = matrix.unpivot(list(keys), [F.col(f"`{n}`") for n in names], "feature", "value")
    return cells.where(F.col("value").isNotNull())


def whole(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key with all its features and their values, as two lists in name order.

    The wide matrix of any vocabulary: absent features take no room.
    """
    cells = F.sort_array(F.collect_list(F.struct("feature", "value")))
    rows = features.groupBy(*keys).agg(cells.alias("cells"))
    return rows.select(
        *keys, F.col("cells.feature").alias("features"), F.col("cells.value").alias("values")
    )


def whole_to_long(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Back from ``whole`` to (key, feature, value)."""
    cells = F.arrays_zip(F.col("features").alias("feature"), F.col("values").alias("value"))
    return rows.select(*keys, F.inline(cells))


def attach(
    cohort: DataFrame, matrix: DataFrame, keys: Sequence[str] = KEYS, fill: float | None = None
) -> DataFrame:
    """Left join of a wide matrix to the cohort; missing cells stay null or get ``fill``."""
    joined = cohort.join(matrix, list(keys), "left")
    added = [c for c in matrix.columns if c not in keys]
    return joined if fill is None else joined.fillna(fill, subset=added)


def feature_index(features: DataFrame) -> DataFrame:
    """A dense id per (family, feature), in name order.

    The vocabulary is range-partitioned and numbered slice by slice, so it never
    has to fit into one task.
    """
    names = features.select("family", "feature").distinct().withColumn("_all", F.lit(0))
    order = [F.col("family"), F.col("feature")]
    return scale.numbered(names, ["_all"], order, "id").drop("_all")


def sparse(features: DataFrame, index: DataFrame) -> DataFrame:
    """Per participant, ascending feature ids and their values.

    A participant's list is as long as the number of distinct features at most.
    """
    spread_by = F.struct(*KEYS)
    coded = scale.sized_join(features, index, ["family", "feature"], spread_by)
    pairs = F.sort_array(F.collect_list(F.struct("id", "value")))
    return (
        coded.groupBy(*KEYS)
        .agg(pairs.alias("cells"))
        .select(
            *KEYS,
            F.col("cells.id").alias("indices"),
            F.col("cells.value").alias("values"),
        )
    )


def covariate_rows(cohort: DataFrame, features: DataFrame, index: DataFrame) -> DataFrame:
    """Every cohort member once, with its sparse covariates (empty when it has none)."""
    joined = cohort.join(sparse(features, index), list(KEYS), "left")
    return joined.withColumn(
        "indices", F.coalesce("indices", F.array().cast("array<bigint>"))
    ).withColumn("values", F.coalesce("values", F.array().cast("array<double>")))


def indicator_vectors(sets: DataFrame, names: Sequence[str], column: str, out: str) -> DataFrame:
    """0/1 ``SparseVector`` of an array column over a listed vocabulary, inside the JVM."""
    model = CountVectorizerModel.from_vocabulary(list(names), inputCol="_terms", outputCol=out)
    named = sets.withColumn("_terms", F.transform(column, lambda c: c.cast("string")))
    return model.setBinary(True).transform(named).drop("_terms")


def matrix_size(features: DataFrame) -> DataFrame:
    """Participants and covariates of a long table."""
    return features.agg(
        F.countDistinct(*KEYS).alias("participants"),
        F.countDistinct("family", "feature").alias("covariates"),
    )
