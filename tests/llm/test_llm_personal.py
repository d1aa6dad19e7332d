from __future__ import annotations

import hashlib
import random
import re

from covaria.llm import personal
from covaria.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = [*"0123456789", *"....", "@", "@", "a", "b", "-", " ", " ", "+", "(", ")", "é", "4111111111111111",
         "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "a@b.co", "+1 (555) 555-1234", "İ", "%"]


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {
        k: [m.span() for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()
    }


def test_base_kinds_equal_the_patterns():
    draw = random.Random(2)
    for _ in range(30000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 25)))
        found = personal.spans(text)
        assert {k: found[k] for k in PATTERNS} == brute(text), text


def test_more_kinds_and_redaction():
    text = "see https://a.b/c?d=1. account no: AB12345, 12 Long Oak Street; password=abc123def x@y.org"
    found = personal.spans(text)
    assert [text[a:b] for a, b in found["url"]] == ["https://a.b/c?d=1"]
    assert [text[a:b] for a, b in found["account"]] == ["AB12345", "abc123def"]
    assert [text[a:b] for a, b in found["address"]] == ["12 Long Oak Street"]
    assert personal.redacted(text) == "see <URL>. account no: <ACCOUNT>, <ADDRESS>; password=<ACCOUNT> <EMAIL>"
    clean = "The lane ends here. No token of account is due on the road"
    assert personal.redacted(clean) == clean


def test_edge_rows(spark):
    long = "word " * 40000 + "a@b.co " + "7" * 30000 + " +" * 5000
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, long), (3, "1.2.3.4"), (3, "1.2.3.4")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in personal.personal_spans(docs).collect())
    assert got == [(0, 1, 0, "email:0:6"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "ip:0:7"), (3, 0, 1, "ip:0:7"), (3, 1, 0, "email:200000:200006")]
    assert personal.personal_spans(docs.limit(0)).collect() == []
    marked = {(r["doc_id"], r["text"]) for r in personal.redact(docs).collect()}
    assert {(1, None), (2, ""), (None, "<EMAIL>"), (3, "<IP>")} <= marked


def test_query_on_all_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES["op5_personal_spans"](spark, sf).collect():
        want = brute(docs[row["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        assert [row[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["spans"].startswith(listed)
