"""Operator 5: personal data by anchors and local parsers.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, schemes, digits and
words that announce an address or account. A parser per kind expands each anchor to the
left and right, and validates what it found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "account", "address")
KINDS = BASE_KINDS + MORE_KINDS

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
LABEL = frozenset(LETTERS + DIGITS + "-")
DIGIT = frozenset(DIGITS)
ALNUM = frozenset(LETTERS + DIGITS)
PHONE = frozenset(DIGITS + " ().-")
URL = frozenset(LETTERS + DIGITS + "-._~:/?#[]@!$&'()*+,;=%")
URL_END = frozenset(".,;:!?'()[]")

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = (
    "account", "acct", "iban", "passport", "ssn", "password", "passwd", "token", "api_key",
    "apikey", "secret",
)
ADDRESS_CUES = ("street", "avenue", "road", "boulevard", "lane", "strasse", "straße", "calle", "rue")
CUE_GAP = re.compile(r"[ \t]{0,3}(?:(?:number|no|nr)\.?[ \t]{0,2})?[:=#]?[ \t]{0,3}[\"']?", re.A)
HOUSE_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,?(?: [^\W\d_][\w'-]{0,30}){1,3} $")
HOUSE_AFTER = re.compile(r"(?: [^\W\d_][\w'-]{0,30}){0,3},? [0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

Span = tuple[int, int]


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    """Anchors of all kinds. A digit is an anchor only for the start of a run (see ``_starts``)."""
    machine = ahocorasick.Automaton()
    for sign in ("@", "+", *DIGITS):
        machine.add_word(sign, ("sign", sign, 1))
    for word in SCHEMES:
        machine.add_word(word, ("scheme", word, len(word)))
    for word in ACCOUNT_CUES:
        machine.add_word(word, ("account", word, len(word)))
    for word in ADDRESS_CUES:
        machine.add_word(word, ("address", word, len(word)))
    machine.make_automaton()
    return machine


def run_end(text: str, start: int, allowed: frozenset) -> int:
    while start < len(text) and text[start] in allowed:
        start += 1
    return start


def run_start(text: str, end: int, allowed: frozenset, floor: int) -> int:
    while end > floor and text[end - 1] in allowed:
        end -= 1
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def email_at(text: str, sign: int, floor: int) -> Span | None:
    """Expand an at-sign to the local part before it and at least two labels after it."""
    start = run_start(text, sign, LOCAL, floor)
    if start == sign:
        return None
    end = run_end(text, sign + 1, LABEL)
    if end == sign + 1:
        return None
    last = end
    while last < len(text) and text[last] == ".":
        label = run_end(text, last + 1, LABEL)
        if label == last + 1:
            break
        last = label
    return (start, last) if last > end else None


def ip_at(text: str, start: int) -> tuple[Span | None, int]:
    """Four dotted numbers from a digit; the place up to which no other can start."""
    parts, end = [], start
    while True:
        stop = run_end(text, end, DIGIT)
        if stop == end:
            return None, end
        parts.append(text[end:stop])
        if len(parts) == 4:
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
            return ((start, stop) if good else None), stop
        if stop >= len(text) or text[stop] != ".":
            return None, stop
        if len(parts) == 1:
            after = stop + 1
        end = stop + 1
        if run_end(text, end, DIGIT) == end:
            return None, after


def card_at(text: str, start: int) -> tuple[Span | None, int]:
    """Digits with single spaces or hyphens between them."""
    end = start + 1
    digits = [text[start]]
    while end < len(text):
        step = 1 if text[end] in " -" else 0
        if end + step >= len(text) or text[end + step] not in DIGIT:
            break
        digits.append(text[end + step])
        end += step + 1
    good = 16 <= len(digits) <= 19 and luhn("".join(digits))
    return ((start, end) if good else None), end


def phone_at(text: str, start: int) -> tuple[Span | None, int]:
    """A plus sign, a digit, and on to the last digit of a run of phone characters."""
    if start + 1 >= len(text) or text[start + 1] not in DIGIT:
        return None, start + 1
    end = run_end(text, start + 2, PHONE)
    while end > start and text[end - 1] not in DIGIT:
        end -= 1
    if end < start + 4:
        return None, start + 1
    count = sum(c in DIGIT for c in text[start:end])
    return ((start, end) if 8 <= count <= 15 else None), end


def url_at(text: str, start: int, size: int) -> Span | None:
    end = run_end(text, start + size, URL)
    while end > start + size and text[end - 1] in URL_END:
        end -= 1
    return (start, end) if end > start + size else None


def account_at(text: str, end: int) -> Span | None:
    """The value after a cue: at least six letters and digits, one of them a digit."""
    gap = CUE_GAP.match(text, end)
    start = gap.end()
    if start == end:
        return None
    if iban := IBAN.match(text, start):
        return iban.span()
    stop = run_end(text, start, ALNUM)
    value = text[start:stop]
    return (start, stop) if len(value) >= 6 and not DIGIT.isdisjoint(value) else None


def address_at(text: str, start: int, end: int) -> Span | None:
    """A house number with one to three words before the cue, or after it."""
    if end < len(text) and text[end].isalnum():
        return None
    if before := HOUSE_BEFORE.search(text, max(0, start - 120), start):
        return before.start(), end
    if start and text[start - 1].isalnum():
        return None
    if after := HOUSE_AFTER.match(text, end):
        return start, after.end()
    return None


def spans(text: str | None) -> dict[str, list[Span]]:
    """Spans by kind, in order, none overlapping another of its kind; offsets are code points.

    The base kinds are the leftmost matches of their patterns; a match that fails its
    check is dropped and the search goes on behind it.
    """
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not text:
        return found
    past = dict.fromkeys(KINDS, 0)

    def keep(kind: str, span: Span | None) -> None:
        if span is not None and span[0] >= past[kind]:
            found[kind].append(span)
            past[kind] = span[1]

    lower = None if text.isascii() and text.islower() else _folded(text)
    for last, (sort, word, size) in _anchors().iter(lower or text):
        start = last - size + 1
        if word == "@":
            if start >= past["email"]:
                keep("email", email_at(text, start, past["email"]))
        elif word == "+":
            if start >= past["phone"]:
                span, floor = phone_at(text, start)
                keep("phone", span)
                past["phone"] = max(past["phone"], floor)
        elif sort == "sign":
            if start >= past["ip"]:
                span, floor = ip_at(text, start)
                keep("ip", span)
                past["ip"] = max(past["ip"], floor)
            if start >= past["card"]:
                span, floor = card_at(text, start)
                keep("card", span)
                past["card"] = max(past["card"], floor)
        elif sort == "scheme":
            keep("url", url_at(text, start, size))
        elif sort == "account":
            keep("account", account_at(text, last + 1))
        else:
            keep("address", address_at(text, start, last + 1))
    return found


def _folded(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(
        c.lower() if len(c.lower()) == 1 else c for c in text
    )


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def redacted(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by the first kind that covers it."""
    if not text:
        return text
    found = spans(text)
    marks = sorted((a, b, rank, kind) for rank, kind in enumerate(KINDS) for a, b in found[kind])
    if not marks:
        return text
    out, past, i = [], 0, 0
    while i < len(marks):
        start, end, rank, kind = marks[i]
        i += 1
        while i < len(marks) and marks[i][0] < end:
            rank, kind = min((rank, kind), marks[i][2:])
            end = max(end, marks[i][1])
            i += 1
        out += (text[past:start], f"<{kind.upper()}>")
        past = end
    out.append(text[past:])
    return "".join(out)


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; a null doc_id stays null; repeated rows are read
    each; other columns are ignored. Texts are read whole.
    """

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            columns: list[list] = [[] for _ in range(len(KINDS) + 2)]
            for text in batch.column("text").to_pylist():
                found = spans(text)
                base = listed(found, BASE_KINDS)
                every = ",".join(part for part in (base, listed(found, MORE_KINDS)) if part)
                digest = hashlib.sha256(base.encode()).hexdigest()
                row = (*(len(found[kind]) for kind in KINDS), digest, every)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    names = [*(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(read, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by marks such as ``<EMAIL>``.

    Every row and column stays. ``n_chars``, where there is one, is counted anew.
    """

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            place = batch.schema.get_field_index("text")
            column = batch.column(place)
            texts = pa.array([redacted(text) for text in column.to_pylist()], column.type)
            yield batch.set_column(place, "text", texts)

    out = docs.mapInArrow(read, docs.schema)
    if "n_chars" in docs.columns:
        return out.withColumn("n_chars", F.length("text").cast("long"))
    return out
