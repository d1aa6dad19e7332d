from __future__ import annotations

import random
import re

from covaria.llm import contamination


def shingles(text):
    words = re.findall(r"[^\W]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items, least=0.8):
    held = {}
    for doc, text in docs:
        if doc is not None:
            held.setdefault(doc, set()).update(shingles(text))
    out = set()
    for item, text in items:
        own = shingles(text)
        for doc, have in held.items():
            if item is not None and own and len(own & have) >= least * len(own) - 1e-9:
                out.add((doc, item, len(own & have), len(own)))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, shingles int"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"),
    )


def test_planted_items(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SLICE_WORDS", 64)
    draw = random.Random(9)
    text = lambda n: " ".join("".join(draw.choices("abcdefg", k=5)) for _ in range(n))
    items = [(i, text(draw.randint(5, 70))) for i in range(30)]
    docs = []
    for i in range(150):
        words = items[i % 30][1].split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = "changed"
        cut = draw.randrange(len(words))
        docs.append((i, " ".join([text(draw.randint(0, 300)), *words[:cut], *([text(3)] if i % 5 == 0 else []), *words[cut:], text(40)])))
    docs, items = docs + [(500, items[0][1].upper() + "!!"), (0, text(9))], items + [(77, items[3][1]), (77, items[4][1])]
    got = {tuple(r) for r in contamination.contained(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items) and len(got) > 50


def test_edge_rows(spark):
    five = "a b c d e"
    docs = [(1, None), (2, ""), (3, five), (3, five), (None, five), (4, "a b c d"), (5, "x " * 30000 + five), (6, "A-b, C.d E!")]
    items = [(1, five), (1, five), (2, None), (3, "a b"), (None, five), (4, "q r s t u v")]
    got = contamination.contained(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, items)) == [(3, 1, 1, 1), (5, 1, 1, 1), (6, 1, 1, 1)]
    none, some = frames(spark, [], []), frames(spark, docs, items)
    assert contamination.contained(none[0], some[1]).collect() == []
    assert contamination.contained(some[0], none[1]).collect() == []


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(contamination.scale, "small", lambda *_: False)
    docs, items = [(i, f"s t {i} a b c d e f") for i in range(50)], [(1, "a b c d e f")]
    got = {tuple(r) for r in contamination.contained(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items) and len(got) == 50
