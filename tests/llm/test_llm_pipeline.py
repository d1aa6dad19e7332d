from __future__ import annotations

import glob
import os

import corpus_pipeline
import duckdb
import pytest
from covaria.llm import contamination, copies, personal, toxicity
from covaria.llm.queries import ORACLES, QUERIES
from covaria.llm.tables import table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(result.fetchall())


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_stages_take_effect_and_keep_the_rest(spark, sf):
    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["toxicity"]
    judged = toxicity.judged(before, table(spark, sf, "labels"))
    assert ids(after) == ids(judged.where("predicted = 0"))
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(copies.near_duplicates(before).where("kept"))
    assert after.count() == len(ids(after))
    before, after = seen["contamination"]
    assert ids(after) == ids(before) - ids(contamination.contained(before, table(spark, sf, "benchmark")))
    before, after = seen["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for row in after.collect():
        assert row["text"] == personal.redacted(texts[row["doc_id"]])
        assert not any(personal.spans(row["text"])[k] for k in personal.BASE_KINDS)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids(mixed) <= ids(docs) and mixed.count() == corpus_pipeline.run(spark, sf).count() > 0


def test_rows_without_and_with_the_same_id(spark, sf):
    rows = [(None, "a b c d e f", "en", "src1", 11), (1, None, None, None, None), (1, "u v w x y z", "en", "src1", 11),
            (1, "u v w x y z", "en", "src1", 11), (2, "u v w x y z", "en", "src2", 11), (3, "", "en", "src2", 0)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == [(1, "u v w x y z"), (1, None), (3, ""), (None, "a b c d e f")]
    assert corpus_pipeline.mix_sources(spark, docs, sf).count() >= 0


def test_each_class_of_texts_keeps_a_row_that_holds_one(spark, sf):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, None), (1, "one two three four five six"), (2, "one two three four five six"), (3, "red blue green grey pink teal"),
            (3, long), (4, long + " end"), (4, long + " end"), (5, ""), (6, ""), (6, ""), (7, None), (7, None), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], table(spark, sf, "documents").schema)
    got = corpus_pipeline.drop_copies(spark, docs, sf).collect()
    want = [(1, None), (1, "one two three four five six"), (3, "red blue green grey pink teal"), (3, long), (5, ""), (6, ""), (7, None), (None, long)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
