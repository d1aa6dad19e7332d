from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from covaria.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, least, first, share=50):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or ("und" if lang is None else lang)].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and v >= least and p in (q[:2], q[1:]) and 100 * v >= share * a for q, v in f.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, phrases.mined(frame, **options).collect()))


def prose(draw, n, letters):
    words = [draw.choice(letters) + draw.choice("xyzé") for _ in range(n)]
    return "".join(w + draw.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for w in words)


def test_equals_brute_force_in_one_and_in_many_rounds(spark, monkeypatch):
    draw = random.Random(4)
    docs = [(prose(draw, draw.randint(0, 60), "abcdef"), draw.choice(["en", "en", "en", "de", None])) for _ in range(120)]
    docs += [("Of the RED house and of the red house. No-one   else", "en")] * 12
    assert mined(spark, docs, least=3, first=15) == brute(docs, 3, 15)
    assert mined(spark, docs, least=3, first=10**6) == brute(docs, 3, 10**6)
    monkeypatch.setattr(phrases, "ROUNDS", (0.2, 0.6))
    want = brute(docs, 3, 20)
    assert mined(spark, docs, least=3, first=20) == want and len({r[0] for r in want}) == 3


def test_edge_rows(spark):
    assert mined(spark, []) == []
    docs = [(None, "en"), ("", None), (None, None), (" \t.,\n", "fr"), ("a b", ""), ("a b", ""), ("A B", ""), ("x" * 3_000_000, "en")]
    assert mined(spark, docs, least=2, first=3) == brute(docs, 2, 3) == [("", 1, "a b", 3, 3, 3, 6, 1000000)]


def test_slices_of_a_long_text_lose_no_phrase(monkeypatch):
    draw = random.Random(5)
    text = prose(draw, 3000, "abc")
    whole = [s for b in phrases.Tally((1, 2, 3), None).rows("en") for s in b.to_pylist()]
    assert whole == [{"lang": "en", "size": 0, "phrase": "", "n": 0}]

    def counted(size, renew):
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        tally, sums = phrases.Tally((1, 2, 3), None), Counter()
        for part in phrases.slices_of(text.encode()):
            tally.add(part)
            if renew:
                sums.update({(r["size"], r["phrase"]): r["n"] for b in tally.rows("en") for r in b.to_pylist()})
                tally = tally.renewed()
        sums.update({(r["size"], r["phrase"]): r["n"] for b in tally.rows("en") for r in b.to_pylist()})
        return +sums

    assert counted(10**9, False) == counted(50, False) == counted(50, True)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 999_999_999_937, 1_000_000_000_039, 999_999_999_989
    frame = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert frame.select(phrases.score_of(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (left * right)


def test_bloom_filter_holds_every_pair(spark):
    pairs = [("en", f"w{i}", f"v{i * 7}") for i in range(2000)]
    bits = phrases.bloom(spark.createDataFrame(pairs, "lang string, x string, y string"))
    code = lambda i: phrases._hash_words([p[i].encode() for p in pairs])
    assert phrases._held(bits, phrases._bits("en", code(1), code(2))).all()
    assert np.mean(phrases._held(bits, phrases._bits("de", code(1), code(2)))) < 0.01
