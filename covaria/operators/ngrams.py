"""N-gram counts and presence features of windowed notes.

``tokenised`` yields one row per note with its tokens and the text that substring
matching looks at. Everything after it works on exploded n-grams, pre-aggregated
before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.functions import text as X
from covaria.operators import scale

GRAM = 3  # signs of the pieces by which substrings are found
NOTE_KEYS = ("note_id", "empi", "expdate", "notedate", "notetype", "days")

# Key columns of each output layout.
LAYOUTS = {
    "empi": ("empi",),
    "empi_expdate": ("empi", "expdate"),
    "empi_expdate_notedate": ("empi", "expdate", "notedate"),
    "empi_expdate_notetype": ("empi", "expdate", "notetype"),
    "empi_expdate_notedate_notetype": ("empi", "expdate", "notedate", "notetype"),
    "empi_expdate_notedate_diff_notetype": ("empi", "expdate", "notedate", "diff", "notetype"),
    "comb_empi_expdate_notedate_diff_notetype": (
        "empi_exp_date",
        "empi",
        "expdate",
        "notedate",
        "diff",
        "notetype",
    ),
}


def tokenised(
    notes: DataFrame,
    preprocessor: str = "nltk",
    stop_words: Sequence[str] = X.ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Windowed notes as ``tokens`` plus the ``body`` they were matched against."""
    text = F.col("text")
    if preprocessor == "nltk":
        bodies = notes.select(*NOTE_KEYS, X.note_body(text, stop_words).alias("body"))
        return bodies.withColumn("tokens", X.body_tokens(F.col("body")))
    if preprocessor == "raw":
        return notes.select(*NOTE_KEYS, text.alias("body"), X.raw_tokens(text).alias("tokens"))
    raise ValueError(f"unknown preprocessor {preprocessor!r}")


def _windows(rows: DataFrame, kept: Sequence[str], array: Column, n: int) -> DataFrame:
    """``kept`` columns, ``parts`` and each ``place`` from which ``n`` of the parts follow.

    Places are listed and not n-grams: lists of text are made item by item outside compiled code.
    """
    cut = rows.select(*kept, array.alias("parts"))
    places = F.when(F.size("parts") >= n, F.sequence(F.lit(0), F.size("parts") - n))
    return scale.exploded(cut, [*kept, "parts"], places, "place")


def _ngrams(tokens: DataFrame, kept: Sequence[str], n: int) -> DataFrame:
    """One row per occurrence of an n-gram in a note."""
    if n == 1:
        return scale.exploded(tokens, kept, F.col("tokens"), "ngram")
    each = _windows(tokens, kept, F.col("tokens"), n)
    parts = [F.get("parts", F.col("place") + i) for i in range(n)]
    return each.select(*kept, F.concat_ws(" ", *parts).alias("ngram"))


def ngram_counts(tokens: DataFrame, n: int) -> DataFrame:
    """Occurrences of each n-gram over all notes."""
    grams = _ngrams(tokens, [], n)
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def top_ngrams(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent n-grams; equal counts by name.

    Most n-grams of a large corpus come once; they are written only if the others do not fill ``k``.
    """
    return scale.largest(counts, k, "n", "ngram", rare=1)


def select_features(tokens: DataFrame, n: int, k: int) -> DataFrame:
    """The top-k vocabulary, staged so that later jobs do not count the corpus again."""
    return scale.staged(top_ngrams(ngram_counts(tokens, n), k), f"top-{n}gram")


def _presence(matches: DataFrame, layout: str) -> DataFrame:
    """Newest note fixes the span per patient; in every other layout the oldest note does.

    Both are an extreme of the signed days, which keeps the aggregate hash-based.
    """
    days = F.min("days") if layout == "empi" else F.max("days")
    keyed = matches.withColumn("diff", F.abs("days")).withColumn(
        "empi_exp_date", K.empi_exp_date(F.col("empi"), F.col("expdate"))
    )
    return keyed.groupBy(*LAYOUTS[layout], "ngram").agg(F.abs(days).alias("span"))


def token_presence(
    tokens: DataFrame,
    n: int,
    layout: str,
    features: DataFrame | None = None,
) -> DataFrame:
    """Span of each n-gram per output key, matched on whole tokens.

    ``features`` (column ``ngram``) limits the result to a vocabulary, which drops
    the rest before the shuffle when it is small enough to broadcast.
    """
    if n == 1:
        matches = scale.exploded(tokens, NOTE_KEYS, F.array_distinct("tokens"), "ngram")
    else:
        matches = _ngrams(tokens, NOTE_KEYS, n)
    if features is not None:
        names = features.select("ngram")
        spread_by = F.struct("note_id", "empi", "expdate")
        matches = scale.sized_join(matches, names, ["ngram"], spread_by, "left_semi")
    return _presence(matches, layout)


def _grams(text: Column, size: int) -> Column:
    """The different pieces of ``size`` signs, as many as the text is long at most."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    pieces = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _pieces_of_one(vocabulary: DataFrame, named: DataFrame) -> DataFrame:
    """Chunks with each feature inside them, found by the feature's rarest piece of ``GRAM`` signs.

    Shorter features are looked up among the chunk's pieces of their length. A chunk has
    fewer than ``GRAM`` pieces for each of its signs, whatever the features.
    """
    features = F.col("feature")
    parts = scale.exploded(named.where(F.length(features) >= GRAM), ["feature"], _grams(features, GRAM), "gram")
    held = scale.exploded(vocabulary, ["chunk"], _grams(F.col("chunk"), GRAM), "gram")
    held = scale.sized_join(held, parts.select("gram").distinct(), ["gram"], F.col("chunk"), "left_semi")
    held = scale.staged(held, "chunk-grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A feature with a piece that no chunk has lies in none.
    rarest = parts.join(counts, "gram", "left").groupBy("feature").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram")
    )
    long = scale.sized_join(held, rarest, ["gram"], F.col("chunk"))
    found = long.where(F.contains("chunk", "feature")).select("chunk", "feature")
    for size in range(1, GRAM):
        pieces = scale.exploded(vocabulary, ["chunk"], _grams(F.col("chunk"), size), "feature")
        short = named.where(F.length(features) == size)
        found = found.unionByName(scale.sized_join(pieces, short, ["feature"], F.col("chunk"), "left_semi"))
    return found


def _ends(parts: Column, n: int) -> tuple[Column, Column, Column]:
    """The first, the middle (space-joined) and the last of ``n`` parts."""
    return F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, n - 2), " "), F.get(parts, F.lit(n - 1))


def _features_of_many(
    chunks: DataFrame, kept: Sequence[str], named: DataFrame, n: int, spread_by: Column
) -> DataFrame:
    """``kept`` columns of ``chunks`` (first, middle, last) with each feature that ends in, spans and starts them.

    Ends of the first chunk are looked up among the features' heads, and starts of the last
    chunk only for those found. The features are few, so chunks stay in their tasks.
    """
    head, middle, tail = _ends(F.split("feature", " "), n)
    keyed = named.select("feature", head.alias("head"), middle.alias("middle"), tail.alias("tail"))
    whole = chunks.where((F.length("first") > 0) & (F.length("last") > 0))
    starts = whole.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("first"))).alias("i"))
    heads = starts.select(*kept, "middle", "last", F.expr("substring(first, i)").alias("head"))
    heads = scale.sized_join(heads, keyed.select("head").distinct(), ["head"], spread_by, "left_semi")
    ends = heads.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("last"))).alias("i"))
    pieces = ends.select(*kept, "head", "middle", F.expr("substring(last, 1, i)").alias("tail"))
    found = scale.sized_join(pieces, keyed, ["head", "middle", "tail"], spread_by)
    return found.select(*kept, "feature")


def contained_features(vocabulary: DataFrame, features: DataFrame) -> DataFrame:
    """The one-token features that each chunk contains, as one list per chunk.

    It is an equi-join on the pieces of distinct chunks, never a test of all pairs.
    """
    found = _pieces_of_one(vocabulary, features.select(F.col("ngram").alias("feature")))
    return found.groupBy("chunk").agg(F.collect_set("feature").alias("found"))


def substring_presence(
    tokens: DataFrame, n: int, layout: str, features: DataFrame
) -> DataFrame:
    """Span of each feature per output key, matched anywhere in the note body.

    A feature has single spaces between its tokens only, so in text cut at single
    spaces its first token ends a chunk, its last token starts one, and the tokens
    between are whole chunks. One-token features lie inside one chunk: only distinct
    chunks are searched, and notes meet the staged result by an equi-join, salted for
    chunks that most notes contain. Neighbouring chunks are too seldom alike for that:
    longer features are looked up where the notes are.
    """
    spread_by = F.struct("note_id", "empi", "expdate")
    chunks = F.split("body", " ")
    if n > 1:
        middle = F.array_join(F.slice("parts", F.col("place") + 2, n - 2), " ") if n > 2 else F.lit("")
        rows = _windows(tokens, NOTE_KEYS, chunks, n).select(
            *NOTE_KEYS,
            F.get("parts", F.col("place")).alias("first"),
            middle.alias("middle"),
            F.get("parts", F.col("place") + (n - 1)).alias("last"),
        )
        named = features.select(F.col("ngram").alias("feature"))
        found = _features_of_many(rows, NOTE_KEYS, named, n, spread_by)
        return _presence(found.withColumnRenamed("feature", "ngram"), layout)
    held = scale.exploded(tokens, NOTE_KEYS, F.array_distinct(chunks), "chunk")
    vocabulary = held.select("chunk").distinct()
    found = scale.staged(contained_features(vocabulary, features), f"found-{n}gram")
    matches = scale.sized_join(held, found, ["chunk"], spread_by)
    return _presence(scale.exploded(matches, NOTE_KEYS, F.col("found"), "ngram"), layout)


def feature_totals(presence: DataFrame) -> DataFrame:
    """Patients with a feature, and rows of the feature set."""
    return presence.agg(
        F.countDistinct("empi").alias("patients"), F.count(F.lit(1)).alias("features")
    )


def as_features(presence: DataFrame, n: int) -> DataFrame:
    """Long feature rows; the value is the span."""
    return presence.select(
        "empi",
        "expdate",
        F.lit(f"ngram{n}").alias("family"),
        F.col("ngram").alias("feature"),
        F.col("span").cast("double").alias("value"),
    )
