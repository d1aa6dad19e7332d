"""Operator 7: language of web pages by fusing evidence.

The posterior of a page's language is the product of

* the likelihood of its text under letter trigrams of each language,
* the chance of its declared markup language given the language,
* the chance of its address suffix (country label, or language part of the path) given it,
* a prior of its host, smoothed towards its domain and that towards all pages.

Chances and priors are sums of text posteriors over all pages, taken by grouped
aggregation. A page's own share is left out of the prior it gets.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.llm.tables import staged

OPENS = re.compile(r"<(?:(?ai:(script|style|noscript|template))\b|!--)")
CLOSES = {None: re.compile("-->")} | {n: re.compile(rf"</(?ai:{n})\s*>") for n in ("script", "style", "noscript", "template")}
TAG = re.compile(r"(?s)<[^>]*>")
LETTERS = re.compile(r"[^\W\d_]+")
# Text evidence counts as at most so many trigrams: neighbouring ones are not independent.
MOST_TRIGRAMS = 60
MEMO_WORDS = 200_000
MARKUP = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible(markup: str | None) -> str:
    """Text of a page without tags, scripts, styles and comments, entities resolved.

    What opens and is never closed stays; the page is read once for each kind of closing tag.
    """
    if not markup:
        return ""
    parts, at, kept, unclosed = [], 0, 0, set()
    while found := OPENS.search(markup, at):
        kind = found[1] and found[1].lower()
        close = None if kind in unclosed else CLOSES[kind].search(markup, found.end())
        at = close.end() if close else found.end()
        if close:
            parts.append(markup[kept : found.start()])
            kept = at
        else:
            unclosed.add(kind)
    shown = " ".join([*parts, markup[kept:]])
    # Beyond the last end of a tag none is closed.
    last = shown.rfind(">") + 1
    return html.unescape(TAG.sub(" ", shown[:last]) + shown[last:])


def trigrams(word: str) -> list[str]:
    padded = f" {word.lower()} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(lang, trigram, n) of labelled ``texts`` (lang, text), summed on the cluster."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: Counter = Counter()
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                words = Counter(LETTERS.findall(text or ""))
                for word, n in words.items():
                    for gram in trigrams(word):
                        held[lang, gram] += n
            rows = [(lang, gram, n) for (lang, gram), n in held.items()]
            yield pd.DataFrame(rows, columns=["lang", "trigram", "n"])

    counted = texts.mapInPandas(count, "lang string, trigram string, n long")
    return counted.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, per_lang: int = 400) -> dict:
    """Trigram model of at most ``per_lang`` documents of each label: the smallest hashes of doc_id.

    ``docs`` has (doc_id, lang, text); rows without a label or text teach nothing. Without
    any the model knows the language ``und`` only.
    """
    known = docs.select("doc_id", F.lower("lang").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    chosen = None
    for lang in langs:
        own = known.where(F.col("lang") == lang).select("doc_id").distinct()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_lang)
        chosen = own if chosen is None else chosen.union(own)
    if chosen is None:
        return {"langs": ["und"], "weights": {}, "default": [0.0]}
    ids = F.broadcast(chosen.distinct())  # at most per_lang rows of 8 bytes a language
    sample = docs.select("doc_id", F.lower("lang").alias("lang"), "text").join(ids, "doc_id")
    rows = trigram_counts(sample.where(F.col("lang").isNotNull()).select("lang", "text")).collect()
    total = Counter()
    for row in rows:
        total[row["lang"]] += row["n"]
    grams = sorted({r["trigram"] for r in rows})
    counts = {(r["lang"], r["trigram"]): r["n"] for r in rows}
    size = len(grams) + 1
    chance = lambda lang, n: math.log((n + 0.5) / (total[lang] + 0.5 * size))
    weights = {g: [chance(lang, counts.get((lang, g), 0)) for lang in langs] for g in grams}
    return {"langs": langs, "weights": weights, "default": [chance(lang, 0) for lang in langs]}


class TextEvidence:
    def __init__(self, model: dict):
        self.weights = {g: np.array(v) for g, v in model["weights"].items()}
        self.default = np.array(model["default"])
        self.memo: dict[str, tuple[np.ndarray, int]] = {}

    def word(self, word: str) -> tuple[np.ndarray, int]:
        if word not in self.memo:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            grams = trigrams(word)
            found = sum((self.weights.get(g, self.default) for g in grams), np.zeros(len(self.default)))
            if len(word) > 64:
                return found, len(grams)
            self.memo[word] = (found, len(grams))
        return self.memo[word]

    def text(self, text: str) -> np.ndarray:
        """Log likelihoods, scaled to ``MOST_TRIGRAMS`` for longer texts and shifted to a maximum of 0."""
        total, n = np.zeros(len(self.default)), 0
        for word, times in Counter(LETTERS.findall(text)).items():
            part, size = self.word(word)
            total += times * part
            n += times * size
        if n:
            total *= min(1.0, MOST_TRIGRAMS / n)
        return total - total.max()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column, host: Column) -> Column:
    """A first path part of two letters, as in /en/, else a host label of two letters, else empty."""
    part = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    label = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return F.when(part != "", F.concat(F.lit("/"), part)).when(label != "", F.concat(F.lit("."), label)).otherwise("")


def evidence(pages: DataFrame, model: dict) -> DataFrame:
    """(page_id, host, domain, declared, suffix, seen) with ``seen`` the log likelihoods of the text."""

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = TextEvidence(model)
        for batch in tables:
            seen = [text.text(visible(h)).tolist() for h in batch.column("html").to_pylist()]
            place = batch.schema.get_field_index("html")
            yield batch.set_column(place, "seen", pa.array(seen, pa.list_(pa.float64())))

    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long"),
        host_of(url).alias("host"),
        F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), MARKUP, 1)).alias("declared"),
        suffix_of(url, host_of(url)).alias("suffix"),
        page.alias("html"),
    ).withColumn("domain", domain_of(F.col("host")))
    names = "page_id long, host string, declared string, suffix string, domain string, seen array<double>"
    return rows.select("page_id", "host", "declared", "suffix", "domain", "html").mapInArrow(read, names)


def _posterior(logs: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raised = [F.exp(x - top) for x in logs]
    total = sum(raised[1:], raised[0])
    return [x / total for x in raised]


def fused(
    pages: DataFrame,
    model: dict,
    host_weight: float = 5.0,
    domain_weight: float = 20.0,
    noise: float = 1.0,
) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host) of every row of ``pages``.

    ``pages`` has (page_id, url, html). A page without text, markup language, suffix or
    host gets its language from what there is; one with nothing gets the most frequent one.
    Null ids and repeated rows have rows of their own; ties go to the first language by
    name; other columns are ignored. ``host_weight`` and ``domain_weight`` are the pages
    that the next wider prior counts for, ``noise`` those spread over all languages in
    the chances of declared languages and suffixes.
    """
    langs = model["langs"]
    n = len(langs)
    rows = staged(evidence(pages, model), "evidence")
    own = _posterior([F.col("seen")[i] for i in range(n)])
    rows = rows.select("*", *(p.alias(f"p{i}") for i, p in enumerate(own)))
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in range(n)]

    everywhere = rows.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    pages_n = everywhere["n"] or 0
    prior = [((everywhere[f"s{i}"] or 0.0) + 1) / (pages_n + n) for i in range(n)]

    def chances(key: str, name: str) -> DataFrame:
        """Log chance of each value of ``key`` given the language; an empty value says nothing."""
        held = rows.where(F.col(key) != "").groupBy(key).agg(*sums)
        held = staged(held, f"chances-{key}")
        whole = held.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n)), F.count(F.lit(1)).alias("n")).first()
        logs = [
            F.log((F.col(f"s{i}") + noise / n) / ((whole[f"s{i}"] or 0.0) + noise / n * ((whole["n"] or 0) + 1))).alias(f"{name}{i}")
            for i in range(n)
        ]
        return held.select(key, *logs)

    domains = rows.groupBy("domain").agg(*sums, F.count(F.lit(1)).alias("n"))
    smooth = [
        ((F.col(f"s{i}") + F.lit(domain_weight * prior[i])) / (F.col("n") + domain_weight)).alias(f"d{i}")
        for i in range(n)
    ]
    domains = staged(domains.select("domain", *smooth), "domain-priors")
    hosts = rows.groupBy("host", "domain").agg(*sums, F.count(F.lit(1)).alias("n"))
    hosts = staged(hosts.join(domains, "domain").drop("domain"), "host-sums")

    out = rows.join(hosts, "host")
    out = out.join(chances("declared", "c"), "declared", "left").join(chances("suffix", "x"), "suffix", "left")
    logs = []
    for i in range(n):
        known = F.when(F.col("host") == "", F.lit(prior[i])).otherwise(
            (F.greatest(F.col(f"s{i}") - F.col(f"p{i}"), F.lit(0.0)) + host_weight * F.col(f"d{i}"))
            / (F.col("n") - 1 + host_weight)
        )
        more = F.coalesce(f"c{i}", F.lit(0.0)) + F.coalesce(f"x{i}", F.lit(0.0))
        logs.append(F.col("seen")[i] + F.log(known) + more)
    final = out.select("*", *(x.alias(f"l{i}") for i, x in enumerate(logs)))
    chance = _posterior([F.col(f"l{i}") for i in range(n)])
    final = final.select("*", *(x.alias(f"q{i}") for i, x in enumerate(chance)))

    def best(prefix: str) -> Column:
        top = F.greatest(*(F.col(f"{prefix}{i}") for i in range(n))) if n > 1 else F.col(f"{prefix}0")
        value = F.lit(langs[-1])
        for i in range(n - 2, -1, -1):
            value = F.when(F.col(f"{prefix}{i}") == top, F.lit(langs[i])).otherwise(value)
        return value

    top = F.greatest(*(F.col(f"q{i}") for i in range(n))) if n > 1 else F.col("q0")
    return final.select(
        "page_id",
        best("q").alias("lang"),
        top.alias("probability"),
        best("p").alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
