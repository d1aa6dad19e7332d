from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from covaria.llm import tokens
from covaria.llm.queries import QUERIES

PATH = public_tokenizers.path(tokens.MODEL)
PARTS = [" ", "  ", "a", "the", "é", "▁", "\n", "\t", "12", "...", "日本", "<s>", "</s>", "\x00", "😀", "'", "ing"]


@pytest.fixture(scope="module")
def whole():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(x) for x in model.encode(texts)]


def test_parts_add_up_to_the_whole_text(whole):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(5000)]
    assert tokens.Counter(PATH).counts(texts) == whole(texts)


def test_slices_of_long_texts(whole, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 40)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 50)
    draw = random.Random(6)
    texts = ["".join(draw.choices(PARTS, k=300)) for _ in range(100)] + ["x" * 5000, " " * 500, "a " * 2000]
    assert [list(tokens.slices(t, 40)) for t in ["ab", ""]] == [["ab"], [""]]
    assert tokens.Counter(PATH).counts(texts) == whole(texts)


def test_edge_rows(spark, whole):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "é" * 3000 + " " + "y" * 9000, "x"), (3, "z", "x"), (3, "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(docs, PATH, 4).collect()), key=repr)
    want = [(d, len((t or "").encode()), n, n > 4) for (d, t, _), n in zip(rows, whole([t or "" for _, t, _ in rows]))]
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(docs.limit(0), PATH).collect() == []


def test_query_on_all_documents(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    counts = whole([d["text"] or "" for d in docs])
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), n, n > 4096) for d, n in zip(docs, counts)}
