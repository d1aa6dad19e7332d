from __future__ import annotations

import html
import random
import re
import time

import pytest
from covaria.llm import language
from covaria.llm.queries import QUERIES

MODEL = None


@pytest.fixture(scope="module")
def model(spark):
    english = "the house and the garden are near this old street with many people walking there "
    german = "das haus und der garten sind nahe dieser alten straße mit vielen menschen die dort gehen "
    rows = [(i, "en", english * 3) for i in range(5)] + [(10 + i, "DE", german * 3) for i in range(5)]
    rows += [(20, None, "x"), (21, "en", None), (None, "en", "y")]
    return language.fitted(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def page(lang, text):
    return f'<html lang="{lang}"><head><script>var house="the";</script></head><body><p>{text}</p></body></html>'


def test_evidence_is_fused(spark, model):
    en, de = "the old house with people", "das alte haus mit menschen"
    rows = [(i, f"https://a.example.org/en/{i}", page("en", en)) for i in range(20)]
    rows += [(100 + i, f"https://b.example.de/x{i}", page("de", de)) for i in range(20)]
    rows += [
        (200, "https://a.example.org/en/z", page("en", "")),  # no text: markup, suffix and host
        (201, "https://b.example.de/z", "<p></p>"),  # host and suffix only
        (202, "https://a.example.org/en/q", page("en", (de + " ") * 20)),  # strong text against the rest
        (203, None, page("de", "")),
        (204, None, None),
        (None, "no address", "<p>" + de),
        (205, "https://b.example.de/z", "<p></p>"),
        (205, "https://b.example.de/z", "<p></p>"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    got = language.fused(frame, model).collect()
    assert len(got) == len(rows)
    lang = {r["page_id"]: r["lang"] for r in got}
    assert [lang[k] for k in (0, 100, 200, 201, 202, 203, None, 205)] == ["en", "de", "en", "de", "de", "de", "de", "de"]
    assert all(0.5 <= r["probability"] <= 1 for r in got)
    assert language.fused(frame.limit(0), model).collect() == []


def test_host_prior_leaves_the_page_out(spark, model):
    """One page alone on its host gets the prior of its domain, not its own text twice."""
    rows = [(i, f"https://h{i}.example.org/", "<p>" + ("the house " if i else "das haus ") * 2) for i in range(30)]
    got = language.fused(spark.createDataFrame(rows, "page_id long, url string, html string"), model)
    assert {r["page_id"]: r["text_lang"] for r in got.collect()}[0] == "de"


def test_no_labels(spark):
    model = language.fitted(spark.createDataFrame([], "doc_id long, lang string, text string"))
    rows = spark.createDataFrame([(1, "https://a.b/", "<p>x")], "page_id long, url string, html string")
    assert [r["lang"] for r in language.fused(rows, model).collect()] == ["und"]


def test_markup_and_text_of_pages():
    assert language.visible("<p>a&amp;b<!-- no --><style>p{}</style>c</p>").split() == ["a&b", "c"]
    assert language.trigrams("Ab") == [" ab", "ab "]


def test_hostile_pages_are_read_once():
    plain = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
    draw = random.Random(1)
    parts = ["<script", "</script>", "<!--", "-->", "<style x>", "</STYLE >", "<p>", "<", ">", " a ", "<scripted>", "<b", "&lt;"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert language.visible(text) == html.unescape(re.sub(r"(?s)<[^>]*>", " ", plain.sub(" ", text)))
    for bad in ("<script ", "<!-- ", "<", "<style><", "</script", "<html lang "):
        start = time.perf_counter()
        language.visible(bad * (160_000 // len(bad)))
        assert time.perf_counter() - start < 0.5


def test_markup_language_of_hostile_pages(spark, model):
    rows = [(1, "https://a.example.de/", "<html " * 30_000), (2, "https://a.example.de/", "<HTML class=x lang = 'DE'>"), (3, "x", "<html lang=" + " " * 100_000)]
    start = time.perf_counter()
    got = {r["page_id"]: r["declared"] for r in language.fused(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[2] == "de" and time.perf_counter() - start < 60


def test_query_agrees_with_most_declarations(spark, sf):
    rows = QUERIES["op7_page_language"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["text_lang"] == r["declared"] for r in rows) >= 0.9 * len(rows)
