"""Covariates from structured codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.operators import cohort as C

KEYS = ("empi", "expdate")
SUFFIX = "_hdec"
DIMENSIONS = ("claims", "rpdr", "combined")


def code_dimension(source: Column, dimension: str) -> Column:
    """Does a file or source name belong to the dimension?"""
    claims, rpdr = source.contains("mcr"), source.contains("rpdr")
    rules = {"claims": claims & ~rpdr, "rpdr": rpdr, "combined": claims | rpdr}
    if dimension not in rules:
        raise ValueError(f"unknown dimension {dimension!r}; use one of {DIMENSIONS}")
    return rules[dimension]


def code_frequency(cohort: DataFrame, events: DataFrame, dimension: str) -> DataFrame:
    """Counts of each code per participant in the look-back window of one dimension."""
    chosen = events.where(code_dimension(F.col("source"), dimension))
    inside = C.cohort_join(
        cohort.select("empi", "expdate"),
        chosen.select("empi", "event_date", "code", "source"),
        "event_date",
    )
    return inside.groupBy(*KEYS, "source", "code").agg(F.count(F.lit(1)).alias("n"))


def binary_codes(frequency: DataFrame) -> DataFrame:
    """0/1 per code, null staying null, names with the binary suffix."""
    return frequency.select(
        *KEYS,
        "source",
        F.concat("code", F.lit(SUFFIX)).alias("code"),
        K.positive_to_one(F.col("n")).alias("value"),
    )


def codes_long(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide code counts as (key, code, n)."""
    counts = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), [F.col(f"`{c}`") for c in counts], "code", "n")


def code_names(frequency: DataFrame) -> list[str]:
    """All codes of a table in name order; a wide table has a column for each."""
    return [r["code"] for r in frequency.select("code").distinct().orderBy("code").collect()]


def codes_wide(frequency: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """One count column per code, all of the table's if none are listed; no event means null."""
    names = code_names(frequency) if codes is None else list(codes)
    return frequency.groupBy(*KEYS).pivot("code", names).agg(F.sum("n"))


def not_binary(values: DataFrame) -> DataFrame:
    """How many values are neither 0 nor 1; a null counts too."""
    bad = F.col("value").isNull() | ~F.col("value").isin(0, 1)
    return values.agg(F.count_if(bad).alias("not_binary"), F.count(F.lit(1)).alias("checked"))


def repeated_covariates(frequency: DataFrame) -> DataFrame:
    """Covariates listed by more than one source for the same participant."""
    per_key = frequency.groupBy(*KEYS, "code").agg(F.count(F.lit(1)).alias("listed"))
    return per_key.where(F.col("listed") > 1)


def checked_binary(binary: DataFrame) -> DataFrame:
    """The same rows; the job fails on a value that is not 0 or 1."""
    ok = F.coalesce(F.col("value").isin(0, 1), F.lit(False))
    passed = F.assert_true(ok, "not all covariates were converted to binary").isNull()
    return binary.where(passed)


def as_features(frequency: DataFrame) -> DataFrame:
    return frequency.select(
        *KEYS,
        F.concat(F.lit("code_"), F.col("source")).alias("family"),
        F.col("code").alias("feature"),
        F.col("n").cast("double").alias("value"),
    )
