from __future__ import annotations

import hashlib
import random

import numpy as np
from covaria.llm import lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, least, keep_first=False):
    places = {}
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if key(line):
                places.setdefault(key(line), []).append((doc is not None, doc, i))
    common = {k: min(p, key=lambda x: (x[0], x[1] or 0, x[2])) for k, p in places.items() if len({(x[0], x[1]) for x in p}) >= least}
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        keep = [key(x) not in common or (keep_first and common[key(x)] == (doc is not None, doc, i)) for i, x in enumerate(own)]
        kept = "\n".join(x for x, k in zip(own, keep, strict=True) if k)
        out.append((doc, len(own), keep.count(False), kept.encode()))
    return sorted(out, key=repr)


def applied(spark, docs, least, keep_first=False):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, at int")
    out = lines.applied(frame, lines.keep_bitmaps(frame, least, keep_first))
    return sorted(((d, n, x, bytes(t)) for d, n, x, t in out.collect()), key=repr)


def test_equals_brute_force_with_a_line_over_many_slices(spark):
    draw = random.Random(8)
    line = lambda: draw.choice(["", " ", "\t", "é É", "HOT", " hot\r", f"Line {draw.randint(0, 40)} ", str(draw.random())])
    docs = [(i, "\n".join(line() for _ in range(draw.randint(1, 12)))) for i in range(400)]
    docs += [(1000 + i, "hot\n" * 30 + f"tail{i % 10}") for i in range(60)]
    for least in (2, 10, 45):
        assert applied(spark, docs, least) == brute(docs, least)
    assert applied(spark, docs, 10, keep_first=True) == brute(docs, 10, keep_first=True)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "a\nb"), (3, "a\nb"), (3, "A\nc"), (None, "a"), (None, "a"), (4, "x" * 2_000_000 + "\n a \n"), (5, "\n\n\n"), (6, " ")]
    assert applied(spark, docs, 3) == brute(docs, 3)
    assert applied(spark, docs, 1) == brute(docs, 1)
    assert applied(spark, [], 10) == []
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.digests(frame).collect()}
    assert got == {(d, n, x, hashlib.sha256(t).hexdigest()) for d, n, x, t in brute(docs, 10)}


def test_bitmap_round_trip():
    keep = np.random.default_rng(1).random(1003) < 0.9
    assert (lines.unpacked(lines.packed(keep), 1003) == keep).all()
    assert len(lines.packed(np.ones(80_000, bool))) < 100
