"""Every registered query against its SQL counterpart on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from covaria.operators import scale
from covaria.plans.catalogue import QUERIES
from covaria.plans.oracles import oracles
from covaria.sources import writers as W

ORACLES = oracles()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    if value is None:
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:10]
    return repr(value) if isinstance(value, float) else str(value)


def check(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(shown(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    check(spark, sf, duck, name)


SHUFFLED = [
    "cohort_notes_join",
    "presence_empi_expdate",
    "presence_substring",
    "presence_substring_bigram",
    "term_frequency",
    "term_names",
    "bag_of_words",
    "coherence_npmi",
    "cluster_cohort",
    "covariates_sparse",
]


@pytest.mark.parametrize("name", SHUFFLED)
def test_query_when_nothing_fits_a_broadcast(spark, sf, duck, name, monkeypatch):
    monkeypatch.setattr(scale, "small", lambda *_: False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, sf, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_entry(spark):
    assert contract.entry(spark).columns == ["empi", "expdate", "ngram", "span"]


# Fitted by random or iterative methods of Spark; test_model_queries.py states what must hold of their rows.
WITHOUT_SQL = {
    "cluster_job", "cluster_sweep", "covariates_modelled", "embed_sentences", "embed_word2vec", "fit_clusters", "fit_topics",
    "log_perplexity", "reuse_models", "topic_contributions", "topic_metrics", "topic_sweep", "topic_terms",
}


def test_every_other_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) - WITHOUT_SQL
    assert set(QUERIES) <= set(contract.queries())


def test_oracles_take_nothing_from_the_package():
    import covaria.plans.oracles as module

    with open(module.__file__) as source:
        assert "from covaria" not in source.read()


def test_largest_breaks_ties_by_name(spark):
    frame = spark.createDataFrame([(f"w{i:02d}", n) for i, n in enumerate([5, 1, 3, 3, 3, 1, 7])], "w string, n int")
    got = lambda k: sorted(r["w"] for r in scale.largest(frame, k, "n", "w").collect())
    assert [got(k) for k in (0, 1, 3, 4, 7, 9)] == [
        [], ["w06"], ["w00", "w02", "w06"], ["w00", "w02", "w03", "w06"], sorted(f"w{i:02d}" for i in range(7)), sorted(f"w{i:02d}" for i in range(7))
    ]


def test_numbered_keeps_null_keys(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    got = scale.numbered(frame, ["k"], [scale.F.col("v")], "rn").collect()
    assert sorted((r["k"] or "", r["v"], r["rn"]) for r in got) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_clean_removes_the_staged_tables(spark):
    held = scale.staged(spark.range(3), "kept")
    assert held.count() == 3
    scale.clean(spark)
    again = scale.staged(spark.range(2), "kept")
    assert again.count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        held.collect()


def test_terms_are_counted_once_for_both_tables(spark, sf, monkeypatch):
    """Failed before: the frequencies were counted again for the 0/1 table, from mentions with all their columns."""
    made, plans, stage, write = {}, [], scale.staged, W.write_mterms

    def staged(df, name, *rest):
        made[name] = stage(df, name, *rest)
        return made[name]

    def written(frequency, binary, path):
        plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (frequency, binary))
        write(frequency, binary, path)

    monkeypatch.setattr(scale, "staged", staged)
    monkeypatch.setattr(W, "write_mterms", written)
    assert QUERIES["roundtrip_terms"](spark, sf).count() == made["frequency"].count()
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)
    assert not {"noteID", "notedate", "key"} & set(made["cohort-mentions"].columns)
