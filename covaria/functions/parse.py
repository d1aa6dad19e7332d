"""List columns that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPIC_LIST = "array<struct<topic:int,weight:double>>"


def cluster_list(text: Column) -> Column:
    """``[1, 2]`` as an integer array."""
    return F.from_json(text, "array<int>")


def topic_list(text: Column) -> Column:
    """``[(3, 0.5), (7, 0.2)]`` as an array of (topic, weight)."""
    pairs = F.from_json(F.translate(text, "()", "[]"), "array<array<double>>")
    return F.transform(
        pairs, lambda p: F.struct(p[0].cast("int").alias("topic"), p[1].alias("weight"))
    )


def topic_text(topics: Column) -> Column:
    """The text form of a topic list."""
    shown = F.transform(
        topics, lambda t: F.concat(F.lit("("), t["topic"], F.lit(", "), t["weight"], F.lit(")"))
    )
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def flat_vector(nested: Column) -> Column:
    return F.flatten(nested)


def heaviest_first(topics: Column) -> Column:
    """Order a topic list by weight, largest first; equal weights by topic id."""
    keyed = F.transform(
        topics, lambda t: F.struct((-t["weight"]).alias("w"), t["topic"].alias("topic"))
    )
    return F.transform(
        F.sort_array(keyed), lambda t: F.struct(t["topic"].alias("topic"), (-t["w"]).alias("weight"))
    )
