"""Operator 6: mixing sources to target weights by hierarchical budgets.

Leaves are paths domain / language / source. A budget of tokens flows down the tree by the
weights of children. A child that cannot use its share (its subtree has too few tokens, over
all allowed epochs) leaves the rest to its siblings; only what all siblings together cannot
use goes to the parent's siblings. All amounts are whole numbers, rounded down.

A leaf takes its documents in a seeded order, anew for each epoch: whole epochs, then the
longest beginning of the next one that fits its budget. The order is the MD5 of seed, epoch
and doc_id. Its first two digits cut a leaf into slices; sums by slice show in which slice
the budget ends; that slice is cut by the next two digits, and only what is left then, a
65,536th of the leaf, is put in order. No leaf is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.llm.tables import staged

LEVELS = ("domain", "lang", "source")
DIGITS = (2, 4, 32)


def tokens_in(text: Column) -> Column:
    """Tokens as the budget counts them: runs of characters other than white space."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def share_out(children: DataFrame, given: DataFrame | int, parent: list[str]) -> DataFrame:
    """``children`` (parent keys, weight, room) with ``budget``: ``given`` is a number, or (parent keys, given).

    Children whose room is small for their weight are filled first; the others share what is
    left by weight. A child without weight gets nothing.
    """
    rows = children.join(given, parent) if parent else children.withColumn("given", F.lit(given))
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(float("inf"))
    keys = [F.col(p) for p in parent]
    ties = [F.col(c) for c in LEVELS if c in children.columns and c not in parent]
    order = Window.partitionBy(*keys).orderBy(ratio, *ties)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("used", F.coalesce(F.sum("room").over(before), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("weight").over(onward))
    # The child fits whole if its fair part of what is left is no less than its room.
    left = F.greatest(F.col("given") - F.col("used"), F.lit(0))
    wide = F.col("room").cast("decimal(38,0)") * F.col("weights")
    full = (F.col("weight") > 0) & (wide <= left.cast("decimal(38,0)") * F.col("weight"))
    rows = rows.withColumn("full", full)
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("filled", F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(every), F.lit(0)))
    rows = rows.withColumn("rest", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    part = F.expr("cast(given - filled as decimal(19,0)) * cast(weight as decimal(18,0)) div rest")
    share = F.when(F.col("weight") <= 0, F.lit(0)).otherwise(F.coalesce(part, F.lit(0)))
    budget = F.when(F.col("full"), F.col("room")).otherwise(F.least("room", share))
    return rows.withColumn("budget", budget.cast("long")).drop(
        "given", "used", "weights", "full", "filled", "rest"
    )


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """Whole-number weight of a child by its name; names not listed weigh 1."""
    listed = weights.get(level, {})
    value = F.lit(1)
    for name, number in sorted(listed.items()):
        value = F.when(F.col(level) == name, F.lit(int(number))).otherwise(value)
    return value.cast("long")


def budgets(
    leaves: DataFrame, total: int, weights: Mapping[str, Mapping[str, int]], epochs: int
) -> DataFrame:
    """(domain, lang, source, tokens, budget) from ``leaves`` (keys, tokens) and a total."""
    room = leaves.withColumn("room", F.col("tokens") * F.lit(epochs))
    given: DataFrame | int = total
    parent: list[str] = []
    for level in LEVELS:
        keys = [*parent, level]
        nodes = room.groupBy(*keys).agg(F.sum("room").alias("room"))
        shared = share_out(nodes.withColumn("weight", _weight(level, weights)), given, parent)
        given = shared.select(*keys, F.col("budget").alias("given"))
        parent = keys
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    domain: Column,
    share_of_tokens: float = 0.5,
    epochs: int = 4,
    seed: int = 11,
    kept: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens) and ``kept``: one row per time a document is taken.

    ``docs`` has (doc_id, text, lang, source). The budget is ``share_of_tokens`` of all
    tokens; ``weights`` has whole numbers by level and name, 1 if not listed. A null lang or
    source, or a null ``domain``, is the name ``unknown``. Texts without tokens and null
    texts cost nothing and are taken in each epoch up to the cut, like others. Repeated
    rows and rows without a doc_id (in the order, an empty one) are documents of their own;
    those with equal order are taken together or not at all. Other columns are ignored.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        name(domain).alias("domain"),
        name(F.col("lang")).alias("lang"),
        name(F.col("source")).alias("source"),
        tokens_in(F.col("text").cast("string")).alias("n_tokens"),
        *(F.col(c).alias(f"kept_{c}") for c in kept),
    )
    keys = list(LEVELS)
    counted = staged(rows.select("doc_id", *keys, "n_tokens"), "token-sizes")
    sizes = counted.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    leaves = staged(sizes, "leaves")
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share_of_tokens)
    plan = budgets(leaves, total, weights, epochs)
    # Whole epochs, and the tokens to take from the one after them.
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", whole)
    plan = staged(
        plan.select(*keys, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("left")),
        "budgets",
    )

    order = F.concat_ws(
        ":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    )
    place = F.md5(order)
    ends = plan.select(*keys, "whole", "left", F.lit("").alias("stop"), F.lit(0).cast("long").alias("before"))
    for digits in DIGITS:
        inside = counted.join(ends, keys).withColumn("place", place)
        inside = inside.where(F.startswith("place", "stop"))
        part = F.substring("place", 1, digits).alias("part")
        sums = inside.groupBy(*keys, "left", "before", part).agg(F.sum("n_tokens").alias("sum"))
        run = Window.partitionBy(*keys).orderBy("part")
        upto = sums.withColumn("upto", F.sum("sum").over(run) + F.col("before"))
        # The first part that goes over the budget is cut further; a leaf without one is taken whole.
        over = upto.where(F.col("upto") > F.col("left")).groupBy(*keys).agg(
            F.min("part").alias("stop"), F.min_by(F.col("upto") - F.col("sum"), "part").alias("before")
        )
        ends = staged(plan.join(over, keys), "ends")
    ends = staged(plan.select(*keys, "whole").join(ends.select(*keys, "stop"), keys, "left"), "ends")
    taken = (rows if kept else counted).join(ends, keys).withColumn("place", place)
    # In the epoch after the whole ones: all before the stop. Past the last epoch: none.
    more = (F.col("whole") < F.lit(epochs)) & (F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    times = F.col("whole") + F.when(more, F.lit(1)).otherwise(F.lit(0))
    numbers = F.when(times > 0, F.sequence(F.lit(1), F.greatest(times, F.lit(1))))
    out = taken.withColumn("epoch", F.explode(numbers))
    return out.select(
        "doc_id", *keys, F.col("epoch").cast("int").alias("epoch"), "n_tokens",
        *(F.col(f"kept_{c}").alias(c) for c in kept if c not in ("lang", "source")),
    )
