from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from covaria.llm import copies
from covaria.llm.graph import components
from covaria.llm.queries import QUERIES
from covaria.llm.tables import words_of


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def bag_of(text):
    words = words_of(text)
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute(rows, similarity=0.8):
    """Class of each doc_id by comparing all pairs with a shingle in common."""
    sets, index, bags = Sets(), defaultdict(list), [(d, bag_of(t)) for d, t in rows]
    for place, (doc, bag) in enumerate(bags):
        sets.find(doc)
        shared = Counter()
        for shingle, n in bag.items():
            for other, m in index[shingle]:
                shared[other] += min(n, m)
            index[shingle].append((place, n))
        for other, both in shared.items():
            whole = bag.total() + bags[other][1].total() - both
            if both >= similarity * whole - 1e-9:
                sets.unite(doc, bags[other][0])
    return {doc: sets.find(doc) for doc, _ in rows}


def test_signatures_are_unbiased():
    draw = np.random.default_rng(0)
    off = []
    for _ in range(40):
        a = {int(x): int(draw.integers(1, 9)) for x in draw.integers(1, 2**62, 30)}
        b = {k: (v if draw.random() < 0.6 else int(draw.integers(1, 40))) for k, v in a.items() if draw.random() < 0.9}
        b.update({int(x): 2 for x in draw.integers(1, 2**62, 4)})
        keys = a.keys() | b.keys()
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        bags = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (a, b)]
        one, two = copies.signatures(bags, 512)
        off.append((one == two).mean() - true)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_signature_does_not_depend_on_its_batch():
    draw = np.random.default_rng(1)
    bags = [(np.unique(draw.integers(1, 2**62, n).astype(np.uint64)), None) for n in (1, 5, 300, 4000)]
    bags = [(s, draw.integers(1, 5, len(s))) for s, _ in bags]
    together = copies.signatures(bags, 252)
    for bag, row in zip(bags, together):
        assert (copies.signatures([bag], 252)[0] == row).all()


def test_components_of_random_links(spark):
    draw = random.Random(3)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    sets = Sets()
    for a, b in links:
        sets.unite(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for link in links if link[0] != link[1] for x in link}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_beginnings_miss_no_similar_pair(spark):
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(2, 60))]
        rows.append((i, i, " ".join(passage + own)))
    for i in range(120, 240):
        words = rows[draw.randint(0, i - 1)][2].split()
        words[draw.randrange(len(words))] = f"n{i}"
        rows.append((i, i, " ".join(words)))
    frame = spark.createDataFrame(rows, "node long, label long, text string")
    bagged = copies.bags(frame.select("node", "text")).join(frame.select("node", "label"), "node")
    pairs = {(r["a"], r["b"]) for r in copies.alike_beginnings(bagged, 0.8).collect()}
    similar = set()
    for i in range(len(rows)):
        for j in range(i):
            x, y = bag_of(rows[i][2]), bag_of(rows[j][2])
            both = (x & y).total()
            if both >= 0.8 * (x.total() + y.total() - both):
                similar.add((j, i))
    assert similar <= pairs and len(pairs) < 3 * len(similar) + 50


@pytest.fixture
def planted():
    """A text with many edited copies, exact copies, texts with one long passage in common, and repeats."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(80)]
    rows = [(1000, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(60 + i, "Same text, the same words again.") for i in range(20)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(80)]
    rows += [(300 + i, "as " * (1000 + 30 * i)) for i in range(5)]
    return rows


def test_planted_groups(spark, planted):
    frame = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in copies.near_duplicates(frame).collect()}
    assert got == brute(planted)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "One, two"), (None, "one two"), (6, "a b c d e f"),
            (7, "x " * 30000), (8, "x " * 29000), (9, "q r s t u v"), (9, "a b c d e f"), (9, "a b c d e f")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, node string, class_id int")
    got = sorted({(r["doc_id"] or 0, r["class_id"], r["kept"]) for r in copies.near_duplicates(frame).collect()}, key=repr)
    assert got == sorted([(0, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False),
                          (6, 6, True), (7, 7, True), (8, 7, False), (9, 6, False)], key=repr)
    assert copies.near_duplicates(frame).count() == len(rows)
    assert copies.near_duplicates(frame.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_near_duplicates"](spark, sf).collect()}
    assert got == brute(docs)
