from __future__ import annotations

import math
import random
import re
from collections import Counter

from covaria.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        rows = []
        for doc, c in counted:
            m = 50 + (50 * c.total() * n_docs) // total if total else 50
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own if c[t]}
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0 and doc is not None:
                rows.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def ranked(spark, docs, items, top=50):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, item_id int")
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, search.ranked(left, right, top).collect()))


def corpus(draw, n, m):
    word = lambda: "w" + str(min(int(draw.paretovariate(0.5)), 400))
    docs = [(i, " ".join(word() for _ in range(draw.choice([0, 3, 30, 200])))) for i in range(n)]
    return docs, [(100 + i, "-".join(word() for _ in range(draw.randint(1, 12)))) for i in range(m)]


def test_equals_brute_force_over_blocks_bundles_and_owners(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 5)
    monkeypatch.setattr(search, "BUNDLE_ITEMS", 4)
    docs, items = corpus(random.Random(6), 300, 15)
    docs += [(500, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (None, None)]
    for top in (3, 50):
        assert ranked(spark, docs, items, top) == brute(docs, items, top)


def test_scores_that_cannot_reach_the_top_are_given_up(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    common, rare = "the of and", " ".join(f"rare{i}" for i in range(8))
    docs = [(i, f"{common} {rare if i % 40 == 0 else 'other'} {i}") for i in range(400)]
    assert ranked(spark, docs, [(1, f"{common} {rare}")], 3) == brute(docs, [(1, f"{common} {rare}")], 3)


def test_terms_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(search.scale, "small", lambda *_: False)
    docs, items = corpus(random.Random(7), 60, 4)
    assert ranked(spark, docs, items, 5) == brute(docs, items, 5)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "Été A-b_c\x7fD"), (3, "été été"), (4, "zzz " * 400_000 + "lone"), (None, "lone"), (5, "ABC abc")]
    items = [(1, "ÉTÉ"), (1, "été"), (2, None), (3, "lone abc b"), (None, "abc"), (4, "absent"), (5, "")]
    assert ranked(spark, docs, items) == brute(docs, items, 50)
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, None)], items) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(search, "SLICE_BYTES", 10)
    text = "Alpha beta-GAMMA, éàü_δοκιμή 12x " * 5 + "y" * 50
    assert [t.decode() for part in search.terms_of(text.encode()) for t in part] == terms(text)
