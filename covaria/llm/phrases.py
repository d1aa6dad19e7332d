"""Operator 11: collocations by best-first branch-and-bound growth of phrases.

One pass counts words and word pairs. A pair ``x y`` bounds every longer phrase that it
begins: such a phrase occurs at most f(x y) times and its part after ``x`` at least as often
as the phrase, so its score is at most f(x y) / f(x). Pairs whose bound, or own score,
reaches a language's threshold are the frontier; a further pass counts the three-word
phrases that the frontier begins, and those that end in a pair whose score reaches it, since
these may drop the pair. A language is settled when its last wanted phrase scores at least
the threshold, because every phrase of such a score is then known exactly. Other languages
lower their threshold and grow again; at threshold 0 all is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.llm.tables import mixed, staged
from covaria.operators import scale

LEAST = 10
FIRST = 2000
SHARE = 50
SCALE = 1_000_000
CLASSES = 20  # of scores for each doubling
# Ranks of the pair score that set the thresholds of the rounds; then everything.
ROUNDS = (1.5, 6.0, 24.0)
BREAK = b"\xff"  # in no UTF-8 text
SLICE_BYTES = 1 << 19
FLUSH_WORDS = 1_000_000
BROADCAST_BYTES = 32 << 20
WORD_BITS = 21
BLOOM_BITS = 1 << 25
BLOOM_KEYS = 3
BITMAP_BITS = 1 << 15  # bits of one value of Spark's bitmap aggregate
PART = np.uint64(0x9E3779B97F4A7C15)


def _folded() -> bytes:
    table = bytearray(range(256))
    for code in range(ord("A"), ord("Z") + 1):
        table[code] = code + 32
    for code in b".,;:!?\n\x0b\x0c\r":
        table[code] = BREAK[0]
    table[9] = 32
    return bytes(table)


FOLDED = _folded()


class Ids(dict):
    """Numbers of words in the order they come; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def slices_of(text: bytes) -> Iterator[bytes]:
    """The folded text, cut between words into parts of about ``SLICE_BYTES``."""
    folded = text.translate(FOLDED).replace(BREAK, b" \xff ")
    at = 0
    while len(folded) - at > SLICE_BYTES:
        cut = folded.find(b" ", at + SLICE_BYTES)
        if cut < 0:
            break
        yield folded[at:cut]
        at = cut
    yield folded[at:]


def runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` words begin that lie in one piece."""
    whole = np.ones(max(0, len(ids) - size + 1), bool)
    for i in range(size):
        whole &= ids[i : i + len(whole)] > 0
    return np.flatnonzero(whole)


class Tally:
    """Counts of one language's phrases: codes of word numbers, summed when they are given out."""

    def __init__(self, sizes: tuple[int, ...], chosen: Callable | None):
        self.sizes, self.chosen = sizes, chosen
        self.ids, self.tail, self.codes, self.words = Ids(), np.zeros(0, np.int64), {s: [] for s in sizes}, 0
        self.hashes = np.zeros(0, np.uint64)

    def add(self, part: bytes) -> None:
        new = self.ids.of(part.split())
        held = len(self.tail)
        both = np.concatenate([self.tail, new])
        self.words += int((new > 0).sum())
        for size in self.sizes:
            row = both[max(0, held - size + 1) :]
            at = runs(row, size)
            if self.chosen is not None:
                at = at[self.chosen(self.hashed()[row], at)]
            code = row[at]
            for i in range(1, size):
                code = (code << WORD_BITS) | row[at + i]
            self.codes[size].append(code)
        self.tail = both[-2:]

    def hashed(self) -> np.ndarray:
        if len(self.hashes) < len(self.ids):
            self.hashes = np.concatenate([self.hashes, _hash_words(list(self.ids)[len(self.hashes) :])])
        return self.hashes

    def renewed(self) -> Tally:
        """An empty tally that goes on where this one ends."""
        words = list(self.ids)
        after = Tally(self.sizes, self.chosen)
        after.tail = after.ids.of([words[i] for i in self.tail])
        return after

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """(lang, size, phrase, n) of what was counted; size 0 is the number of words."""
        words = pa.array(list(self.ids), pa.binary())
        yield _batch(lang, 0, pa.array([""]), np.array([self.words]))
        for size, codes in self.codes.items():
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                places = [(part >> (WORD_BITS * (size - 1 - i))) & (2**WORD_BITS - 1) for i in range(size)]
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in places), pa.scalar(b" ", pa.binary()))
                yield _batch(lang, size, phrase.cast(pa.string()), n[at : at + 50_000])


COUNTS = "lang string, size tinyint, phrase string, n long"


def _batch(lang: str, size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(size, pa.int8()), len(n)), phrases, pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])


def counts(texts: DataFrame, sizes: tuple[int, ...], chosen=None) -> DataFrame:
    """Counts of phrases per language and batch of texts, to be summed; ``texts`` is (lang, text).

    ``chosen(lang)`` gives a test of phrases by word numbers, or None if the language has none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        tests: dict[str, Callable | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts_of: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if chosen is not None and lang not in tests:
                        tests[lang] = chosen(lang)
                    if chosen is None or tests[lang] is not None:
                        texts_of.setdefault(lang, []).append(text or b"")
                for lang, held in texts_of.items():
                    tally = tallies.setdefault(lang, Tally(sizes, tests.get(lang)))
                    for piece in slices_of(b"\n".join([*held, b""])):
                        tally.add(piece)
                        # A slice brings fewer new words than the numbers that are left.
                        if len(tally.ids) > 2 ** (WORD_BITS - 1) or tally.words > FLUSH_WORDS:
                            yield from tally.rows(lang)
                            tally = tallies[lang] = tally.renewed()
            if sum(t.words for t in tallies.values()) > FLUSH_WORDS:
                for lang, tally in tallies.items():
                    yield from tally.rows(lang)
                tallies = {}
        for lang, tally in tallies.items():
            yield from tally.rows(lang)

    return texts.mapInArrow(count, COUNTS)


def _hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _bits(lang: str, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Places of word pairs, given by the hashes of their words, in the bits of a language's Bloom filter."""
    pair = mixed(first * PART + second) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
    return [mixed(pair + np.uint64(k)) % np.uint64(BLOOM_BITS) for k in range(1, BLOOM_KEYS + 1)]


def bloom(pairs: DataFrame) -> np.ndarray:
    """Bloom filter of (lang, x, y): 4 MiB of bits, built by Spark's bitmap aggregate, whatever the number of pairs."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, x, y in zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "y")), strict=True):
                found += [int(b[0]) for b in _bits(lang, _hash_words([x.encode()]), _hash_words([y.encode()]))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["place"])

    rows = pairs.select("lang", "x", "y").mapInArrow(places, "place long")
    block = (F.col("place") / BITMAP_BITS).cast("int")
    inside = (F.col("place") % BITMAP_BITS).cast("long")
    made = rows.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(inside).alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    width = BITMAP_BITS // 8
    for block, bits in made.collect():  # at most BLOOM_BITS / BITMAP_BITS rows of 4 KiB
        out[block * width : (block + 1) * width] = np.frombuffer(bits, np.uint8)
    return out


def _held(bits: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(places[0]), bool)
    for place in places:
        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _growth(starts: np.ndarray, ends: np.ndarray, open_langs: np.ndarray) -> Callable:
    """For each language a test of three-word phrases: its first pair is in ``starts`` or its last in ``ends``."""

    def of(lang: str):
        empty = _hash_words([b""])
        if not _held(open_langs, _bits(lang, empty, empty))[0]:
            return None

        def test(words: np.ndarray, at: np.ndarray) -> np.ndarray:
            x, y, z = words[at], words[at + 1], words[at + 2]
            return _held(starts, _bits(lang, x, y)) | _held(ends, _bits(lang, y, z))

        return test

    return of


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact up to counts of 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def mined(docs: DataFrame, least: int = LEAST, first: int = FIRST, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two and three words.

    ``docs`` is (text, lang), other columns are ignored. A null lang is ``und``, a null text
    empty; repeated rows count as often as they come. A phrase occurs ``least`` times or more;
    one that lies in a longer phrase with at least ``share`` percent of its occurrences is
    dropped. Equal scores go by occurrences, then by the bytes of the phrase. Languages
    without a phrase have no row; an empty table gives none.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    summed = counts(texts, (1, 2)).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    held = staged(summed.where((F.col("size") == 0) | (F.col("n") >= least)), "phrase-counts")
    totals = held.where("size = 0").select("lang", "n")
    pairs = _pairs(held)
    found = []
    open_langs = staged(pairs.select("lang").distinct(), "phrase-langs")
    for rank in [*(int(first * r) for r in ROUNDS), None]:
        limits = staged(_limits(pairs.join(open_langs, "lang"), rank), "phrase-limits")
        near = pairs.join(limits, "lang")
        near = staged(near.where((F.col("score") >= F.col("tau")) | (F.col("bound") >= F.col("tau"))), "frontier")
        good = near.where(F.col("score") >= F.col("tau"))
        marks = limits.select("lang", F.lit("").alias("x"), F.lit("").alias("y"))
        test = _growth(bloom(near), bloom(good), bloom(marks))
        grown = counts(texts, (3,), test).where("size = 3").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        # Written first, so that a join that counts its keys does not read the texts again.
        triples = staged(_triples(staged(grown.where(F.col("a") >= least), "grown"), pairs), "triples")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = _surviving(good, triples, limits, share).withColumn("rank", F.row_number().over(best).cast("long"))
        ranked = staged(ranked.where(F.col("rank") <= first), "ranked")
        full = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        state = staged(limits.join(full, "lang", "left").select("lang", ((F.col("tau") == 0) | (F.coalesce("n", F.lit(0)) >= first)).alias("done")), "settled")
        found.append(ranked.join(state.where("done").select("lang"), "lang", "left_semi"))
        open_langs = state.where("NOT done").select("lang")
        if rank is None or open_langs.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _pairs(held: DataFrame) -> DataFrame:
    """Word pairs with the counts of their words, their score, and the bound of all phrases that they begin."""
    part = lambda i: F.substring_index("phrase", " ", i)
    words = held.where("size = 1")
    pairs = held.where("size = 2").select("lang", "phrase", F.col("n").alias("a"), part(1).alias("x"), part(-1).alias("y"))
    pairs = scale.sized_join(pairs, words.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l")), ["lang", "x"], F.col("phrase"), limit_bytes=BROADCAST_BYTES)
    pairs = scale.sized_join(pairs, words.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r")), ["lang", "y"], F.col("phrase"), limit_bytes=BROADCAST_BYTES)
    bound = F.call_function("div", F.col("a").cast("decimal(15,0)") * F.lit(SCALE).cast("decimal(7,0)"), F.col("l").cast("decimal(15,0)"))
    return staged(pairs.select("lang", "phrase", "x", "y", "a", "l", "r", score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), bound.alias("bound")), "pairs")


def _limits(pairs: DataFrame, rank: int | None) -> DataFrame:
    """(lang, tau): a score that ``rank`` or a few more of a language's pairs reach, 0 where it has fewer.

    Pairs are counted by the size of their score, a few hundred classes a language, so no
    language is ordered in one task.
    """
    if rank is None:
        return pairs.select("lang").distinct().withColumn("tau", F.lit(0).cast("long"))
    size = F.floor(CLASSES * F.log2(F.col("score") + 1))
    classes = pairs.groupBy("lang", size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    above = Window.partitionBy("lang").orderBy(F.desc("size"))
    summed = classes.select("lang", "least", F.sum("n").over(above).alias("upto"))
    sized = summed.groupBy("lang").agg(F.max(F.when(F.col("upto") >= rank, F.col("least"))).alias("least"))
    return sized.select("lang", F.coalesce("least", F.lit(0)).cast("long").alias("tau"))


def _triples(grown: DataFrame, pairs: DataFrame) -> DataFrame:
    """Three-word phrases with both pairs in them, and the lower of the scores of their two cuts, the first of equal ones."""
    begin = F.substring_index("phrase", " ", 2).alias("begin")
    end = F.substring_index("phrase", " ", -2).alias("end")
    rows = grown.select("lang", "phrase", "a", begin, end)
    first = pairs.select("lang", F.col("phrase").alias("begin"), F.col("a").alias("l2"), F.col("l").alias("l1"))
    last = pairs.select("lang", F.col("phrase").alias("end"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    rows = scale.sized_join(rows, first, ["lang", "begin"], F.col("phrase"), limit_bytes=BROADCAST_BYTES)
    rows = scale.sized_join(rows, last, ["lang", "end"], F.col("phrase"), limit_bytes=BROADCAST_BYTES)
    s1, s2 = (score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2))
    cut = lambda one, two: F.when(F.col("s1") <= F.col("s2"), F.col(one)).otherwise(F.col(two))
    rows = rows.withColumns({"s1": s1, "s2": s2})
    return rows.select("lang", "phrase", "begin", "end", "a", cut("l1", "l2").alias("l"), cut("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))


def _surviving(good: DataFrame, triples: DataFrame, limits: DataFrame, share: int) -> DataFrame:
    """Phrases that reach their language's threshold and lie in no longer one with most of their occurrences."""
    inside = triples.select("lang", F.col("begin").alias("phrase"), "a").union(triples.select("lang", "end", "a"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    kept = good.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    long = triples.join(limits, "lang").where(F.col("score") >= F.col("tau"))
    return kept.select(*columns).unionByName(long.select(*columns))
