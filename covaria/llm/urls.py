"""Operator 8: URL filters from rules and from mined association rules.

Only DataFrame, SQL and Spark ML functions are used, all of them on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.llm.tables import staged
from covaria.operators import scale

# Verdict and prefix (host, then path) of each stated rule.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        inside = (host == name) | F.endswith(host, F.lit("." + name))
        fits = inside & F.startswith(path, F.lit(slash + start))
        named = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, named).otherwise(fitting)
    return fitting


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of, each once: scheme, host labels and suffixes, path words, query keys.

    Numbers in path words are one sign, so that pages of one kind share a token.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:/?#]*)://", 1))),
            suffixes,
            F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
            F.transform(pairs, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1))),
        )
    )


def mine(
    labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float
) -> DataFrame:
    """(rule_id, items, confidence, support) of combinations that mark bad URLs.

    ``labelled`` has (items, bad). ``min_support`` is a share of the bad baskets, so how many
    others are labelled does not matter. Equal baskets stay apart: FP-growth counts them. A
    rule goes if part of its items is a rule of at least its confidence.
    """
    sums = labelled.agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    share = sums["bad"] / max(1, sums["all"])
    baskets = labelled.select(
        F.when(F.col("bad"), F.concat(F.col("items"), F.array(F.lit(BAD))))
        .otherwise(F.col("items"))
        .alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support * share, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    kept = rules.where(F.col("lift") >= min_lift).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support"
    )
    kept = staged(kept.withColumn("rule_id", F.xxhash64("items")), "url-rules")
    return staged(_without_wider(kept), "url-rules-pruned")


def _without_wider(rules: DataFrame) -> DataFrame:
    """Drop a rule that holds all items of another rule of at least its confidence.

    Candidates meet by the first item of the smaller rule, so no pairs of unrelated rules.
    """
    small = rules.select(
        F.col("rule_id").alias("by"),
        F.col("items").alias("fewer"),
        F.col("confidence").alias("at"),
        F.element_at("items", 1).alias("item"),
    )
    wide = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item"))
    beaten = wide.join(small, "item").where(
        (F.col("by") != F.col("rule_id"))
        & (F.col("at") >= F.col("confidence"))
        & (F.size("fewer") < F.size("items"))
        & (F.size(F.array_except("fewer", "items")) == 0)
    )
    return rules.join(beaten.select("rule_id").distinct(), "rule_id", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_key`` of pages that hold all items of some rule.

    The inverted index lists each rule under its rarest item, so a page meets only rules
    whose rarest item it has; the other items are then compared.
    """
    spread = rules.select("rule_id", "items", F.explode("items").alias("item"))
    frequency = spread.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    listed = spread.join(frequency, "item").groupBy("rule_id", "items").agg(
        F.min_by("item", F.struct("n", "item")).alias("item")
    )
    index = staged(listed.select("item", F.col("items").alias("needed")), "url-index")
    probes = pages.select("page_key", "items", F.explode("items").alias("item"))
    hits = (
        probes.join(F.broadcast(index), "item")
        if scale.small(index)
        else scale.salted_join(probes, index, ["item"], F.col("page_key"))
    )
    return hits.where(F.size(F.array_except("needed", "items")) == 0).select("page_key").distinct()


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    min_support: float = 0.004,
    min_confidence: float = 0.5,
    min_lift: float = 1.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    The longest stated rule that fits decides; else a page is blocked if it holds a mined
    combination, and allowed if not. ``labels`` (page_id, bad) marks URLs to learn from; a
    combination counts if ``min_support`` of the bad pages have it;
    with no bad label nothing is mined. Null URLs and those without ``://`` have an empty
    host and path. Repeated rows and null ids have rows of their own; other columns are
    ignored.
    """
    url = F.col("url").cast("string")
    read = pages.select(F.col("page_id").cast("long"), url.alias("url"))
    read = read.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    items = tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    full = read.withColumn("items", items).withColumn("page_key", F.md5(F.to_json("items").cast("binary")))
    marked = labels.select(F.col("page_id").cast("long"), F.col("bad").cast("boolean"))
    marked = marked.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    learn = full.select("page_id", "items").join(marked, "page_id")
    found = matched(full.dropDuplicates(["page_key"]), mine(learn, min_support, min_confidence, min_lift))
    stated = stated_rule(F.col("host"), F.col("path"), rules)
    blocked = found.select("page_key", F.lit(True).alias("mined"))
    # Pages of one kind share a key, so a key may hold a third of all pages.
    out = scale.salted_join(full, blocked, ["page_key"], F.xxhash64("url", "page_id"), "left").withColumn("stated", stated)
    verdict = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("stated.rule").alias("rule"),
        F.coalesce("stated.verdict", verdict).alias("verdict"),
        F.coalesce("mined", F.lit(False)).alias("mined"),
    )
