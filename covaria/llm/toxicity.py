"""Operator 3: toxicity by a subsequence string kernel and Nyström landmarks.

The kernel compares two strings by their subsequences of three letters; a subsequence
counts ``DECAY`` to the power of the stretch it spans, so letters put between those of an
insult lower the match and do not end it. The labelled texts give the words: those that hold
a stretch of letters marking toxic texts, and all words of clean texts. A linear SVM is
trained on the Nyström features of words; landmarks are marks and frequent clean words. Because features are kernels with the landmarks, the trained SVM is
one weight per subsequence; scoring a word takes its own subsequences only.

A text scores by its most toxic words, turned into a probability on training documents that
the SVM has not seen.
"""

from __future__ import annotations

import math
import random
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.llm.tables import WordHashes, mixed

LETTERS = 64
ORDER = 3
DECAY = 0.6
WINDOW = 16
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MEMO_WORDS = 100_000
LEAST_SHARE = 0.4
FALSE_MARKS = 0.1
MARK_LETTERS = (3, 10)
LANDMARKS = 512
COMMON_WORDS = 192
TOP_WORDS = 3
SPLITS = 3
# Signs that stand for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
# Single letters and separators have no sign in common, so every text is read once.
SPACED = re.compile(r"(?<!\S)[^\s.*_-](?:[\s.*_-]++[^\s.*_-](?![^\s.*_-])){2,}")


def tokens_of(text: str | None) -> set[str]:
    """Lower-case pieces between spaces, and letters written apart put together."""
    if not text:
        return set()
    lower = text.lower()
    found = set(lower.split())
    for apart in SPACED.finditer(lower):
        found.add("".join(apart[0].split()))
    return found


def letters_of(token: str) -> str:
    """Only letters, with signs read as letters when the token has letters of its own."""
    if token.isascii() and token.isalpha():
        return token
    token = unicodedata.normalize("NFKC", token)
    if any(c.isalpha() for c in token):
        token = token.strip(".,;:!?\"'()[]").translate(SIGNS)
    return "".join(c for c in token if c.isalpha())


def strings_of(token: str) -> list[str]:
    """The token's letters; long ones as windows that overlap by half."""
    letters = letters_of(token)
    if len(letters) <= WINDOW:
        return [letters]
    step = WINDOW // 2
    return [letters[i : i + WINDOW] for i in range(0, len(letters) - step, step)]


@lru_cache(maxsize=WINDOW + 1)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0)


def _letters(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    plain = codes - 96
    other = 27 + codes * 2654435761 % 2**32 % (LETTERS - 27)
    return np.where((plain > 0) & (plain < 27), plain, other)


def subsequences(words: list[str], block: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``words``, codes, weights) for words of one length at a time; a unit norm each.

    Words of fewer than three letters have no subsequence and are left out.
    """
    sizes = defaultdict(list)
    for i, word in enumerate(words):
        if ORDER <= len(word) <= WINDOW:
            sizes[len(word)].append(i)
    for length, members in sizes.items():
        places, weights = _places(length)
        room = max(1, block // len(places))
        for at in range(0, len(members), room):
            chosen = members[at : at + room]
            letters = _letters([words[i] for i in chosen]).reshape(-1, length)[:, places]
            codes = (letters[..., 0] * LETTERS + letters[..., 1]) * LETTERS + letters[..., 2]
            values = np.broadcast_to(weights, codes.shape)
            # Equal subsequences of a word add up before the norm is taken.
            rows = np.arange(len(chosen))[:, None] * LETTERS**ORDER
            _, inverse = np.unique(codes + rows, return_inverse=True)
            inverse = inverse.reshape(codes.shape)
            sums = np.bincount(inverse.ravel(), weights=values.ravel())
            norm = np.sqrt((values * sums[inverse]).sum(axis=1, keepdims=True))
            yield np.array(chosen), codes, values / norm


class Scorer:
    """Margins of tokens by the trained weight of each subsequence."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(LETTERS**ORDER)
        self.table[codes] = weights
        self.bias = bias
        self.memo: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for places, codes, values in subsequences(words):
            out[places] += (self.table[codes] * values).sum(axis=1)
        return out

    def learn(self, tokens: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [t for t in tokens if t not in self.memo]
        parts = [strings_of(t) for t in new]
        margins = self.words([s for p in parts for s in p])
        at = 0
        for token, part in zip(new, parts, strict=True):
            self.memo[token] = float(margins[at : at + len(part)].max())
            at += len(part)

    def texts(self, token_sets: list[set[str]]) -> np.ndarray:
        """Of each text: its highest margin, the mean of the next ones, and how many words lie above 0."""
        self.learn(set().union(*token_sets))
        least = min(self.bias, -1.0)
        out = np.empty((len(token_sets), 3))
        for i, tokens in enumerate(token_sets):
            margins = np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))
            top = np.full(1 + TOP_WORDS, least)
            best = np.sort(margins)[::-1][: 1 + TOP_WORDS]
            top[: len(best)] = best
            above = (margins > 0).sum()
            out[i] = top[0], top[1:].mean(), above / math.log(math.e + len(tokens))
        return out


class Examples:
    """Words as their subsequences among those ``held``, for margins under many weights."""

    def __init__(self, words: list[str], held: np.ndarray):
        index = np.full(LETTERS**ORDER, -1)
        index[held] = np.arange(len(held))
        rows, codes, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for places, code, value in subsequences(words):
            known = index[code]
            at, column = np.nonzero(known >= 0)
            rows.append(places[at].astype(np.int32))
            codes.append(code[at, column].astype(np.int32))
            values.append(value[at, column].astype(np.float32))
        self.size = len(words)
        self.rows, self.codes, self.values = map(np.concatenate, (rows, codes, values))

    def margins(self, codes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        table = np.zeros(LETTERS**ORDER)
        table[codes] = weights
        return np.bincount(self.rows, table[self.codes] * self.values, self.size) + bias


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    held = np.unique(np.concatenate([c.ravel() for _, c, _ in subsequences(landmarks)]))
    table = np.zeros((len(held) + 1, len(landmarks)))
    for places, codes, values in subsequences(landmarks):
        np.add.at(table, (np.searchsorted(held, codes), places[:, None]), values)
    out = np.zeros((len(words), len(landmarks)))
    index = np.full(LETTERS**ORDER, len(held))
    index[held] = np.arange(len(held))
    for places, codes, values in subsequences(words, 20_000):
        known = index[codes]
        rows, columns = np.nonzero(known < len(held))
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(rows):
            parts = table[known[rows, columns]] * values[rows, columns][:, None]
            out[places[rows[cuts]]] = np.add.reduceat(parts, cuts, axis=0)
    return out


def unlike(documents: list[set[str]], bands: int = 3) -> list[int]:
    """Places without near copies, whose chance words would else look frequent: word-set MinHash, two rows a band."""
    seen: set[tuple] = set()
    kept = []
    hashes = WordHashes()
    for i, words in enumerate(documents):
        codes = hashes.of(list(words)) if words else np.zeros(1, np.uint64)
        least = [int(mixed(codes + np.uint64(seed)).min()) for seed in range(2 * bands)]
        keys = {(b, *least[2 * b : 2 * b + 2]) for b in range(bands)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def parts_of(word: str) -> Iterator[str]:
    """All stretches of a word with ``MARK_LETTERS`` letters; ``<`` and ``>`` are its ends."""
    least, most = MARK_LETTERS
    padded = f"<{word}>"
    for at in range(len(padded)):
        for end in range(at + least, min(len(padded), at + most + 2) + 1):
            yield padded[at:end]


def _frequent_parts(documents: list[set[str]]) -> Counter:
    """Stretches in three documents or more; a longer one is counted only if both of its parts are."""
    least, most = MARK_LETTERS
    held: Counter = Counter()
    alive: set[str] = set()
    active = [[f"<{w}>" for w in words] for words in documents]
    for size in range(least, most + 3):
        level: Counter = Counter()
        pieces: dict[str, tuple[str, ...]] = {}
        same: dict[str, str] = {}  # one string for equal pieces of all words
        for words in active:
            found: set[str] = set()
            for w in words:
                own = pieces.get(w)
                if own is None:
                    own = (w[i : i + size] for i in range(len(w) - size + 1))
                    own = own if size == least else (p for p in own if p[1:] in alive and p[:-1] in alive)
                    own = pieces[w] = tuple(same.setdefault(p, p) for p in own)
                found.update(own)
            level.update(found)
        alive = {p for p, n in level.items() if n > 2}
        held.update({p: level[p] for p in alive if least <= len(p.strip("<>")) <= most})
        # Words without a frequent stretch of this size have no longer one.
        going = {w for w, own in pieces.items() if not alive.isdisjoint(own)}
        active = [[w for w in words if w in going] for words in active]
    return held


class Evidence:
    """Toxic and clean documents that each stretch of letters is in, for each of ``SPLITS`` parts of the documents.

    Every document is read once for all trainings. Stretches that cannot reach ``LEAST_SHARE``
    any more, in whatever parts, are given up while the clean documents are read.
    """

    def __init__(self, toxic: list[set[str]], clean: list[set[str]]):
        kept = unlike(toxic)
        self.toxic = [[toxic[i] for i in kept if i % SPLITS == part] for part in range(SPLITS)]
        self.clean = [clean[part::SPLITS] for part in range(SPLITS)]
        # Each stretch is one string, which all words share.
        self.held = {p: p for p in _frequent_parts([toxic[i] for i in kept])}
        self.known: dict[str, tuple[str, ...]] = {}
        self.hits = [Counter() for _ in range(SPLITS)]
        self.seen = [Counter() for _ in range(SPLITS)]
        for part, documents in enumerate(self.toxic):
            for words in documents:
                self._count(self.hits[part], words)
        check = 32
        for i in range(len(clean)):
            self._count(self.seen[i % SPLITS], clean[i])
            if i == check:
                check *= 2
                self._give_up()

    def _count(self, counts: Counter, words: set[str]) -> None:
        found: set[str] = set()
        for word in words:
            parts = self.known.get(word)
            if parts is None:
                parts = self.known[word] = tuple(self.held[p] for p in parts_of(word) if p in self.held)
            found.update(parts)
        counts.update(found)

    def _give_up(self) -> None:
        for part in list(self.held):
            hits, seen = sum(h[part] for h in self.hits), [s[part] for s in self.seen]
            if hits < LEAST_SHARE * (hits + sum(seen) - max(seen)):
                del self.held[part]
        self.hits, self.seen = ([Counter({k: n for k, n in c.items() if k in self.held}) for c in g] for g in (self.hits, self.seen))
        self.known = {}

    def marks(self, without: int | None = None) -> list[str]:
        """Stretches of letters that mark toxic documents, most frequent first; none lies in another.

        A stretch found in ``a`` documents must be so toxic that, were labels dealt by chance,
        fewer than ``FALSE_MARKS`` of the stretches in so many documents would be. It is lengthened
        as long as it keeps nearly all of its documents. Their number has no limit.
        """
        used = [p for p in range(SPLITS) if p != without]
        toxic, clean = ([w for p in used for w in group[p]] for group in (self.toxic, self.clean))
        if not toxic or not clean:
            return []
        share = _highest_share(toxic, clean)
        hits = {k: sum(self.hits[p][k] for p in used) for k in self.held}
        hits = {k: n for k, n in hits.items() if n > 2}
        total = {k: n + sum(self.seen[p][k] for p in used) for k, n in hits.items()}
        among = Counter(total.values())
        # Far more toxic than the documents of any language are on the whole.
        wanted = max(LEAST_SHARE, min(0.9, 3 * share))
        pure = {k: n for k, n in hits.items() if n >= wanted * total[k] and among[total[k]] * _tail(n, total[k], share) < FALSE_MARKS}
        return _longest(pure)


def _longest(pure: dict[str, int]) -> list[str]:
    longer = defaultdict(list)
    for k in pure:
        longer[k[:-1]].append(k)
        longer[k[1:]].append(k)
    chosen: set[str] = set()
    covered: set[str] = set()
    for mark in sorted(pure, key=lambda k: (-pure[k], k)):
        if mark in covered:
            continue
        while longer[mark]:
            best = max(longer[mark], key=lambda k: (pure[k], k))
            if pure[best] < 0.95 * pure[mark]:
                break
            mark = best
        inside = {mark[i:j] for i in range(len(mark)) for j in range(i + 3, len(mark) + 1)}
        if chosen.isdisjoint(inside):
            chosen.add(mark)
        covered |= inside
    return sorted(chosen, key=lambda k: (-pure[k], k))


def _highest_share(toxic: list[set[str]], clean: list[set[str]]) -> float:
    """The share of toxic documents where it is highest: among those with some everyday word.

    A language may have more toxic documents than others; its everyday words show it.
    """
    known = Counter(w for words in clean for w in words)
    marked = Counter(w for words in toxic for w in words)
    everyday = [w for w, n in known.items() if n >= 0.03 * len(clean) and n + marked[w] >= 50]
    shares = [marked[w] / (marked[w] + known[w]) for w in everyday]
    return max([*shares, len(toxic) / (len(toxic) + len(clean))])


@lru_cache(maxsize=100_000)
def _tail(hits: int, total: int, share: float) -> float:
    """Chance that ``hits`` or more of ``total`` documents are toxic by chance."""
    return sum(math.exp(math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share)) for k in range(hits, total + 1))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the examples inside the margin."""
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge
    eye[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (x @ w) < 1
        xi, wi = x[inside], weight[inside]
        new = np.linalg.solve(eye + (xi * wi[:, None]).T @ xi, (xi * wi[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Slopes and offset of a sigmoid, with smoothed targets and a ridge on the slopes."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + pull @ w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return w


def chance(model: dict, features: np.ndarray) -> np.ndarray:
    """Probability of label 1 from the features of texts."""
    if not model["codes"]:
        return np.full(len(features), float(model["share"]))
    *slopes, offset = model["sigmoid"]
    return 1 / (1 + np.exp(-np.clip(features @ np.array(slopes) + offset, -30, 30)))


def train(
    toxic: list[set[str]], clean: list[set[str]], seed: int = 7, counts: tuple[int, int] | None = None
) -> dict:
    """Model from the words of toxic and clean documents; a constant one if it can learn nothing.

    ``counts`` are the toxic and the other labelled documents of which these are a sample; the
    chances hold for them, whatever the ratio of the sample. The sigmoid is fitted on
    documents that the SVM in use has not seen: ``SPLITS`` times it is trained without every
    ``SPLITS``-th document, and these are scored.
    """
    stand = counts or (len(toxic), len(clean))
    share = stand[0] / max(1, sum(stand))
    toxic, clean = (_unique(group) for group in (toxic, clean))
    evidence = Evidence(toxic, clean)
    marks = [evidence.marks(part) for part in [*range(SPLITS), None]]
    del evidence
    features, truth = [np.zeros((0, 3))], [np.zeros(0)]
    for part in range(SPLITS):
        rest = [[w for i, w in enumerate(group) if i % SPLITS != part] for group in (toxic, clean)]
        if (machine := _machine(*rest, marks[part], seed)) is not None:
            for group, label in ((toxic, 1.0), (clean, 0.0)):
                if group[part::SPLITS]:
                    features.append(Scorer(*machine).texts(group[part::SPLITS]))
                    truth.append(np.full(len(features[-1]), label))
    machine = _machine(toxic, clean, marks[-1], seed)
    x, y = np.concatenate(features), np.concatenate(truth)
    if machine is None or len(set(y)) < 2:
        return {"codes": [], "weights": [], "bias": -1.0, "sigmoid": [0.0] * 4, "share": share}
    codes, weights, bias = machine
    # Each document stands for as many labelled ones as the sample left out of its class.
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return {
        "codes": codes.tolist(), "weights": weights.tolist(), "bias": bias,
        "sigmoid": _logistic(x, y, weight).tolist(), "share": share,
    }


def _unique(documents: list[set[str]]) -> list[set[str]]:
    """Different documents, in an order that does not depend on how they came."""
    held = {" ".join(sorted(words)): words for words in documents}
    return [held[k] for k in sorted(held)]


def _machine(
    toxic: list[set[str]], clean: list[set[str]], marks: list[str], seed: int
) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The SVM as subsequence codes, their weights, and the bias; None without a mark.

    Toxic examples are all words of toxic documents that hold a mark anywhere and are seldom in
    others; all other words of clean documents are clean examples. Landmarks are a basis only.
    """
    if not marks:
        return None
    draw = random.Random(seed)
    frequent = Counter(w for words in clean for w in words if ORDER <= len(w) <= WINDOW)
    marked = Counter(w for words in toxic for w in words if ORDER <= len(w) <= WINDOW)
    held = set(marks)
    positive = sorted(w for w, n in marked.items() if n >= LEAST_SHARE * (n + frequent[w]) and not held.isdisjoint(parts_of(w)))
    marks = list(dict.fromkeys(mark.strip("<>") for mark in marks))
    varied = set()
    for mark in sorted({*marks, *draw.sample(positive, min(len(positive), 200))}):
        for place in range(1, len(mark)):
            varied.add((mark[:place] + draw.choice("abcdefghijklmnopqrstuvwxyz") + mark[place:])[:WINDOW])
    varied = sorted(varied - frequent.keys())
    common = [w for w, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]]
    landmarks = list(dict.fromkeys([*marks[: LANDMARKS - COMMON_WORDS], *common]))
    square = _kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh(square + 1e-8 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    negative = sorted(frequent.keys() - set(positive))
    draw.shuffle(negative)
    # An everyday word that is taken for toxic would do so in every text that has it.
    often = np.sqrt([frequent[w] for w in negative])
    features = lambda words: np.hstack([_kernel(words, landmarks) @ whiten, np.ones((len(words), 1))])
    good = features([*positive, *varied])
    every = Examples(negative, _weights(landmarks, np.zeros(len(landmarks)), 0.0)[0])
    used = np.argsort(-often, kind="stable")[:5000]
    trained = np.zeros(len(negative), bool)
    trained[used] = True
    other = features([negative[i] for i in used])
    for _ in range(5):  # add the clean words that the last model takes for toxic
        x = np.vstack([good, other])
        y = np.r_[np.ones(len(good)), -np.ones(len(other))]
        weight = np.r_[np.full(len(positive), 1.0), np.full(len(varied), 0.3), often[used]]
        w = _svm(x, y, weight, 1e-2)
        machine = _weights(landmarks, whiten @ w[:-1], float(w[-1]))
        wrong = (every.margins(*machine) > -0.9) & ~trained
        if not wrong.any():
            break
        trained |= wrong
        used = np.r_[used, np.flatnonzero(wrong)]
        other = np.vstack([other, features([negative[i] for i in np.flatnonzero(wrong)])])
    return machine


def _weights(landmarks: list[str], shares: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
    """A weighted sum of kernels with landmarks as one weight per subsequence."""
    held = np.unique(np.concatenate([c.ravel() for _, c, _ in subsequences(landmarks)]))
    table = np.zeros(LETTERS**ORDER)
    for places, codes, values in subsequences(landmarks):
        np.add.at(table, codes, values * shares[places][:, None])
    return held, table[held], bias


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1000, clean_ratio: int = 3) -> dict:
    """Train on a bounded sample: at most ``per_class`` toxic documents, ``clean_ratio`` times as many others.

    The sample is the smallest hashes of doc_id among labelled rows outside the held-out
    fold; the labels of a doc_id count as toxic if one of them is. Only the distinct words
    of these documents come to the driver. The chances are those among all labelled rows.
    A text is scored by words of ``ORDER`` letters or more; an insult is learned from three
    toxic documents on, or more if the labels leave it in doubt (``Evidence.marks``).
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").orderBy(by_hash).limit(per_class)
    clean = known.where("toxic = 0").orderBy(by_hash).limit(per_class * clean_ratio)
    sample = F.broadcast(toxic.union(clean))  # at most per_class * (1 + clean_ratio) rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id")

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = []
            for text in frame["text"]:
                strings = {s for t in tokens_of(text) for s in strings_of(t)}
                held.append(" ".join(sorted(s for s in strings if len(s) >= ORDER)))
            yield pd.DataFrame({"toxic": frame["toxic"], "words": held})

    rows = texts.mapInPandas(words, "toxic int, words string").collect()
    groups: tuple[list, list] = ([], [])
    for mark, held in sorted(map(tuple, rows)):
        groups[mark].append({sys.intern(w) for w in held.split()})
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return train(groups[1], groups[0], counts=(sizes.get(1, 0), sizes.get(0, 0)))


def scored(docs: DataFrame, model: dict, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` and ``score`` of every row of ``docs`` (doc_id, text): the chance of label 1.

    Null and empty texts score like a text without a toxic word; a null doc_id stays null;
    repeated rows are scored each; other columns are ignored. Texts are read whole.
    """

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(np.array(model["codes"], np.int64), np.array(model["weights"]), model["bias"])
        for batch in tables:
            out = []
            for at in range(0, batch.num_rows, 200):
                texts = batch.column("_text").slice(at, 200).to_pylist()
                out.append(scorer.texts([tokens_of(t) for t in texts]))
            scores = chance(model, np.concatenate([np.zeros((0, 3)), *out]))
            columns = [batch.column(c) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*kept, "score"])

    chosen = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    return chosen.mapInArrow(score, T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, learned from ``labels``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scored(docs, fitted(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= F.lit(THRESHOLD)).cast("int")
    return rows.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))
