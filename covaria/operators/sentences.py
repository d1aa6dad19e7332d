"""Sentences with abbreviations learned from the notes.

A full stop ends a sentence unless it belongs to an abbreviation. Whether a word is one shows
in the notes: it stands with a full stop far more often than words do on the whole (the
log-likelihood ratio of Kiss and Strunk 2006), it is short, and it is seldom seen without.
The counts are one grouped aggregation; no note is seen twice by a driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.functions import text as X
from covaria.operators import scale

# The chance of a full stop after an abbreviation, and the least score of one.
CHANCE = 0.99
LEAST_SCORE = 0.3
ENDED = r"^(.*[\p{L}\p{N}])\.$"


def _type(word: Column) -> Column:
    """The lower-cased word, without signs around it; a full stop at its end stays."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def full_stop_counts(notes: DataFrame) -> DataFrame:
    """(word, with_stop, without): how often each word stands with and without a full stop after it."""
    each = scale.exploded(notes, [], F.transform(X.words(F.col("text")), _type), "word")
    stopped = each["word"].rlike(ENDED)
    base = F.regexp_replace("word", r"\.$", "")
    counted = each.where(base != "").groupBy(base.alias("word"), stopped.alias("stopped"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"))
    n = lambda ends: F.coalesce(F.sum(F.when(F.col("stopped") == ends, F.col("n"))), F.lit(0)).cast("long")
    return sums.groupBy("word").agg(n(True).alias("with_stop"), n(False).alias("without"))


def abbreviations(notes: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(word, score) of the abbreviations in ``notes`` (text)."""
    counts = scale.staged(full_stop_counts(notes), "full-stops")
    sums = counts.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).alias("all"))
    rows = counts.where("with_stop > 0").join(F.broadcast(sums))  # one row of two numbers
    share = F.col("stops").cast("double") / F.col("all")
    both, others = F.col("with_stop").cast("double"), F.col("without").cast("double")
    plain = both * F.ln(share) + F.when(others > 0, others * F.ln(1 - share)).otherwise(0.0)
    marked = both * F.ln(F.lit(CHANCE)) + others * F.ln(F.lit(1 - CHANCE))
    stops = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - stops).cast("double")
    score = -2 * (plain - marked) * F.exp(-letters) * (stops + 1) * F.pow(letters, -others)
    found = rows.select("word", score.alias("score"))
    return found.where(F.col("score") >= least)


def split(notes: DataFrame, known: DataFrame) -> DataFrame:
    """One row per sentence of ``notes`` (note_id, text): its place and its text.

    Notes are cut at white space after ``.``, ``!`` and ``?``, and a piece that ends in one of the
    ``known`` abbreviations (word) goes on with the next, after one space. Sentences of blanks are left out.
    """
    pieces = scale.placed(notes, ["note_id"], X.sentences(F.col("text")), "piece", "part")
    last = _type(F.element_at(F.split("part", X.WHITESPACE), -1))
    pieces = pieces.withColumn("word", F.when(last.rlike(ENDED), F.regexp_replace(last, r"\.$", "")))
    marked = scale.sized_join(pieces, known.select("word", F.lit(1).alias("open")), ["word"], F.col("note_id"), "left")
    before = Window.partitionBy("note_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(1 - F.coalesce("open", F.lit(0))).over(before), F.lit(0))
    grouped = marked.withColumn("sentence", ended).groupBy("note_id", "sentence")
    parts = grouped.agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    text = F.array_join("parts.part", " ")
    rows = parts.select("note_id", F.col("sentence").cast("int").alias("position"), text.alias("document"))
    return rows.where(F.trim("document") != "")
