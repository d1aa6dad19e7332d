from __future__ import annotations

import hashlib
import random

import pytest
from covaria.llm import mixture
from pyspark.sql import functions as F

WEIGHTS = {"domain": {"d0": 3, "d2": 0}, "lang": {"en": 2}, "source": {"s1": 5}}


def share_out(given, children):
    """Budgets of (name, weight, room): fill whole children one by one while any fits."""
    out, left, open_ = {}, given, {n: (w, r) for n, w, r in children if w > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, r) in open_.items() if r * total <= left * w]
        if not full:
            out.update({n: min(r, left * w // total) for n, (w, r) in open_.items()})
            break
        name = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        out[name] = open_.pop(name)[1]
        left -= out[name]
    return {n: out.get(n, 0) for n, *_ in children}


def brute(docs, share, epochs, seed):
    leaves = {}
    for doc, dom, lang, src, n in docs:
        leaves.setdefault((dom, lang, src), []).append((doc, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(mixture.LEVELS):
        for parent in {k[:depth] for k in leaves}:
            names = sorted({k[depth] for k in leaves if k[:depth] == parent})
            room = lambda name: sum(t * epochs for k, t in tokens.items() if k[: depth + 1] == (*parent, name))
            shared = share_out(budget[parent], [(n, WEIGHTS[level].get(n, 1), room(n)) for n in names])
            budget.update({(*parent, n): b for n, b in shared.items()})
    taken = []
    for leaf, rows in leaves.items():
        whole, left = divmod(budget[leaf], tokens[leaf]) if tokens[leaf] else (0, budget[leaf])
        taken += [(doc, *leaf, e) for doc, _ in rows for e in range(1, whole + 1)]
        if whole < epochs:
            place = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()
            places = sorted({place(d) for d, _ in rows})
            upto = 0
            for p in places:
                upto += sum(n for d, n in rows if place(d) == p)
                if upto > left:
                    break
                taken += [(d, *leaf, whole + 1) for d, _ in rows if place(d) == p]
    return sorted(taken, key=repr)


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 1), (1.7, 2), (5.0, 3), (0.0, 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    draw = random.Random(int(share * 10))
    docs = []
    for i in range(400):
        source = draw.choice(["s0"] * 6 + ["s1", "s2", None])
        docs.append((i, f"d{draw.choice([0, 0, 0, 1, 2])}", draw.choice(["en", "en", "de", None]), source, draw.randint(0, 30)))
    docs += [(7, "d0", "en", "s0", 5), (7, "d0", "en", "s0", 5), (None, "d1", "de", "s1", 3)]
    rows = [(d, " ".join(["w"] * n) if n else None, lang, src, dom) for d, dom, lang, src, n in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    got = mixture.mixed(frame, WEIGHTS, F.col("epoch"), share, epochs, 5)
    got = sorted(((r["doc_id"], r["domain"], r["lang"], r["source"], r["epoch"]) for r in got.collect()), key=repr)
    named = [(d, dom, lang or "unknown", src or "unknown", n) for d, dom, lang, src, n in docs]
    assert got == brute(named, share, epochs, 5)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixture.mixed(frame, {}, F.lit(None)).collect() == []
