from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from helpers import INDEX, cohort, notes, rows
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import functions as F

from covaria.config import JobConfig
from covaria.operators import clusters as CL
from covaria.operators import coherence as CH
from covaria.operators import embeddings as E
from covaria.operators import matrix as M
from covaria.operators import topics as TP
from covaria.operators.cohort import note_window
from covaria.plans import jobs as PL
from covaria.sources import fixtures as FX
from covaria.sources import readers as R
from covaria.sources import writers as W


def test_cluster_sets_and_onehot(spark):
    labelled = spark.createDataFrame([("1", 4), ("1", 1), ("1", 4), ("2", 0)], "empi string, cluster int")
    sets = CL.cluster_sets(labelled)
    assert rows(sets) == [("1", [1, 4], 2), ("2", [0], 1)]
    assert rows(CL.cluster_onehot(sets, 5)) == [("1", 0, 1, 0, 0, 1), ("2", 1, 0, 0, 0, 0)]
    vectors = M.indicator_vectors(sets, [str(i) for i in range(5)], "cluster", "v")
    assert {r["empi"]: list(r["v"].indices) for r in vectors.collect()} == {"1": [1, 4], "2": [0]}


def test_cluster_sample_and_stats(spark):
    labelled = spark.createDataFrame([(0, f"t{i % 30:02d}") for i in range(90)] + [(1, "x")], "cluster int, document string")
    sample = CL.cluster_sample(labelled, 20)
    assert sample.where("cluster = 0").count() == 20
    assert rows(sample.where("cluster = 1")) == [(1, "x", 1)]
    assert rows(CL.cluster_stats(labelled)) == [(0, 30, 90), (1, 1, 1)]


def blobs(spark, n=120):
    rng = random.Random(3)
    data = [(i, str(i % 7), f"d{i % 11}", [10.0 * (i % 3) + rng.random(), rng.random()]) for i in range(n)]
    return spark.createDataFrame([*data, (n, "1", "d", None)], "vec_id long, empi string, document string, embedding array<float>")


def test_clusters_of_blobs(spark, tmp_path):
    frame = blobs(spark)
    model = W.reused_model(spark, str(tmp_path / "m"), KMeansModel, lambda: CL.fit_clusters(frame, 3))
    again = W.reused_model(spark, str(tmp_path / "m"), KMeansModel, lambda: pytest.fail("fitted twice"))
    got = CL.predicted(again, frame)
    assert got.count() == 120
    assert got.select((F.col("vec_id") % 3).alias("b"), "cluster").distinct().count() == 3
    assert len(model.clusterCenters()) == 3
    swept = rows(CL.cluster_sweep(frame, (2, 3)))
    assert swept[0][2] > swept[1][2]


@pytest.mark.parametrize("parts", [1, 5])
def test_sweep_equals_the_k_means_of_spark(spark, parts):
    """Failed before: every fit ran in as many tasks as the file had."""
    rng = random.Random(4)
    data = [(i, [rng.gauss(i % 9, 0.4), rng.random(), rng.gauss(0, 3)]) for i in range(300)]
    frame = spark.createDataFrame([*data, (300, None)], "vec_id long, embedding array<float>").coalesce(parts)
    vectors = CL.with_vector(frame).select("embedding", "features").persist()
    seen = []
    spy = pytest.MonkeyPatch()
    spy.setattr(CL, "_moved", lambda points, c, real=CL._moved: (seen.append(points.rdd.getNumPartitions()), real(points, c))[1])
    try:
        swept = rows(CL.cluster_sweep(frame, (3, 40, 300, 301)))
    finally:
        spy.undo()
    for k, clusters, cost in swept:
        model = KMeans(k=k, seed=0, initMode="random").fit(vectors.select("features"))
        assert clusters == len(model.clusterCenters())
        assert cost == pytest.approx(model.summary.trainingCost, rel=1e-9, abs=1e-9)
    assert sorted(k for k, _, _ in swept) == [3, 40, 300]
    assert set(seen) == {2 * spark.sparkContext.defaultParallelism}
    vectors.unpersist()


def test_nearest_centre_equals_brute_force(spark):
    frame = blobs(spark)
    centres = spark.createDataFrame([(5, [0.0, 0.0]), (2, [10.0, 1.0]), (9, [20.0, 0.5])], "cluster int, centre array<double>")
    points = {r["cluster"]: r["centre"] for r in centres.collect()}
    for row in CL.assign_clusters(frame, centres).collect():
        assert row["cluster"] == min(points, key=lambda c: math.dist(points[c], row["embedding"]))


def topic_notes(spark):
    rng = random.Random(5)
    pools = (["heart", "valve", "aorta", "pulse"], ["lung", "cough", "asthma", "sputum"])
    data = [(i, str(i % 6), "Car", i % 300, " ".join(rng.choices(pools[i % 2], k=12))) for i in range(80)]
    return note_window(notes(spark, data))


def test_topic_vocabulary_limits(spark):
    data = [(i, "1", "Car", 1, "common " + ("rare" if i < 2 else "seldom" if i < 5 else "")) for i in range(10)]
    tokens = TP.topic_tokens(note_window(notes(spark, data)))
    assert rows(TP.document_frequency(tokens, 3, 0.9)) == [("seldom", 3)]
    assert rows(TP.document_frequency(tokens, 1, 1.0, keep=1)) == [("common", 10)]
    kept = TP.document_frequency(tokens, 2, 0.9)
    assert rows(TP.bag_of_words(tokens, kept)) == [(0, "rare", 1), (1, "rare", 1), (2, "seldom", 1), (3, "seldom", 1), (4, "seldom", 1)]


def test_topic_model_invariants(spark):
    tokens = TP.topic_tokens(topic_notes(spark))
    terms = TP.vocabulary_list(TP.document_frequency(tokens, 2, 0.9))
    assert len(terms) == 8
    vectors = TP.vectorised(tokens, terms)
    model = TP.fit_topics(vectors, 2, passes=5)
    for row in TP.contributions(model, vectors).collect():
        weights = [t["weight"] for t in row["topic_contributions"]]
        assert sum(weights) <= 1 + 1e-9
        assert weights == sorted(weights, reverse=True)
        assert min(weights) >= TP.MIN_WEIGHT
    again = TP.fit_topics(vectors, 2, passes=5)
    assert TP.fit_topics(vectors, 2, optimizer="em", iterations=5).vocabSize() == 8
    same = lambda m: rows(m.describeTopics(3), "topic", "termIndices")
    assert same(model) == same(again)
    words = TP.topic_terms(model, terms, 4)
    found = {frozenset(r["term"] for r in words.where(f"topic = {t}").collect()) for t in (0, 1)}
    assert found == {frozenset(["heart", "valve", "aorta", "pulse"]), frozenset(["lung", "cough", "asthma", "sputum"])}
    assert TP.log_perplexity(model, vectors) < 0


def test_topic_matrices(spark):
    lists = spark.createDataFrame(
        [(1, "1", [(3, 0.5), (1, 0.2)]), (2, "1", [(1, 0.4)]), (3, "2", [])],
        "note_id long, empi string, topic_contributions array<struct<topic:int,weight:double>>",
    )
    assert rows(TP.topic_pivot(lists, 4, ["note_id"])) == [(1, 0.0, 0.2, 0.0, 0.5), (2, 0.0, 0.4, 0.0, 0.0)]
    pooled = TP.max_pool_matrix(cohort(spark, ["1", "2"]), lists, 4)
    assert rows(pooled) == [("1", INDEX, 0.0, 0.4, 0.0, 0.5), ("2", INDEX, 0.0, 0.0, 0.0, 0.0)]
    assert rows(TP.binary_matrix(pooled)) == [("1", INDEX, 0, 1, 0, 1), ("2", INDEX, 0, 0, 0, 0)]


def brute_counts(docs, words, window):
    """Windows with each word, and with each pair, by listing the windows."""
    single: dict = {}
    both: dict = {}
    total = 0
    for doc in docs:
        if not doc:
            continue
        spans = [doc[s : s + window] for s in range(max(len(doc) - window + 1, 1))]
        total += len(spans)
        for span in spans:
            here = sorted(set(span) & set(words))
            for w in here:
                single[w] = single.get(w, 0) + 1
            for pair in combinations(here, 2):
                both[pair] = both.get(pair, 0) + 1
    return single, both, total


@pytest.mark.parametrize("window", [2, 5, 10, 110])
def test_window_counts_equal_brute_force(spark, window):
    rng = random.Random(window)
    docs = [rng.choices(["aaa", "bbb", "ccc", "ddd", "eee", "fff"], k=rng.randint(0, 25)) for _ in range(40)]
    tokens = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "note_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "aaa"), (0, 2, "bbb"), (0, 3, "ccc")], "topic int, rank int, term string")
    single, both, total = brute_counts(docs, ["aaa", "bbb", "ccc"], window)
    pairs = CH.pair_table(tokens, words, window).collect()
    assert len(pairs) == 3
    for p in pairs:
        assert p["total"] == total
        assert p["n1"] == single[p["t1"]]
        assert p["n2"] == single[p["t2"]]
        assert p["n_both"] == both.get(tuple(sorted((p["t1"], p["t2"]))), 0)


def test_pairs_are_counted_inside_the_tasks(spark, monkeypatch):
    """Failed before: a row was made for each pair of words that a note has."""
    rng = random.Random(2)
    terms = [f"w{i:02d}" for i in range(12)]
    docs = [rng.choices([*terms, "xxx", None], k=rng.randint(0, 400)) for _ in range(30)]
    tokens = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "note_id long, tokens array<string>").repartition(2)
    # Two topics share words, and only the best six words of each are asked for.
    words = [(t, r + 1, terms[(r + 4 * t) % 12]) for t in (0, 1) for r in range(8)]
    words = spark.createDataFrame(words, "topic int, rank int, term string")
    near = sorted(terms[(r + 4 * t) % 12] for t in (0, 1) for r in range(6))
    single, both, total = brute_counts(docs, near, 10)
    for cells, wide in ((CH.CELLS, CH.WIDE), (36, CH.WIDE), (36, 3)):  # whole notes, few windows, few pairs at a time
        monkeypatch.setattr(CH, "CELLS", cells)
        monkeypatch.setattr(CH, "WIDE", wide)
        places = CH.word_places(tokens, words)
        counted = CH.pair_table(tokens, words, 10, 6, places).collect()
        assert len(counted) == 30 and {p["total"] for p in counted} == {total}
        for p in counted:
            assert (p["n1"], p["n2"]) == (single[p["t1"]], single[p["t2"]])
            assert p["n_both"] == both.get(tuple(sorted((p["t1"], p["t2"]))), 0)
    low, high = CH.word_pairs(words, 6)
    assert len(low) == 29 and (low < high).all()  # the two topics have one of 30 pairs in common
    sent = CH._counted(terms, np.ones(12, bool), low, high, 10)
    batches = places.select("length", "places").toArrow().to_batches(7)
    (batch,) = sent(iter(batches))
    assert batch.num_rows <= 12 + len(low)


def test_rows_of_one_note_are_one_for_the_counts(spark):
    tokens = [(1, ["aaa", "xxx", "bbb"]), (1, ["aaa", "xxx", "bbb"]), (None, ["aaa", "bbb", "x"]), (None, ["bbb", "aaa", "x"]), (2, None), (3, ["x"])]
    frame = spark.createDataFrame(tokens, "note_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "aaa"), (0, 2, "bbb")], "topic int, rank int, term string")
    (pair,) = CH.pair_table(frame, words, 2).collect()
    # Windows of note 1: 2 with neither pair; of the unnamed note: both words at 0 and 1.
    assert (pair["n1"], pair["n2"], pair["n_both"], pair["total"]) == (3, 3, 2, 9)


def test_coherence_of_words_that_always_meet(spark):
    tokens = spark.createDataFrame([(i, ["aaa", "bbb"] if i % 2 else ["ccc"]) for i in range(10)], "note_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "aaa"), (0, 2, "bbb"), (1, 1, "aaa"), (1, 2, "ccc")], "topic int, rank int, term string")
    npmi = dict(rows(CH.coherence(tokens, words, "c_npmi")))
    assert npmi[0] == pytest.approx(1.0, abs=1e-6)
    assert npmi[1] < -0.9
    umass = dict(rows(CH.coherence(tokens, words, "u_mass")))
    assert umass[0] == pytest.approx(0.0, abs=1e-6)
    assert dict(rows(CH.coherence(tokens, words, "c_v")))[0] == pytest.approx(1.0, abs=1e-6)
    uci = dict(rows(CH.coherence(tokens, words, "c_uci")))
    assert uci[0] == pytest.approx(math.log(2), abs=1e-6)
    assert rows(CH.average(CH.coherence(tokens, words, "c_uci")))[0][0] == pytest.approx((uci[0] + uci[1]) / 2)


def test_embeddings(spark):
    tokens = TP.topic_tokens(topic_notes(spark))
    hashed = E.hashed_embeddings(tokens, 40).collect()
    assert {len(r["embedding"]) for r in hashed} == {40}
    assert all(abs(x) <= 1 for r in hashed for x in r["embedding"])
    model = E.fit_word_vectors(tokens, size=8, min_count=1)
    assert E.document_embeddings(model, tokens).count() == 80
    assert E.word_embeddings(model, tokens).count() == 80 * 12
    lengths = lambda: lambda texts: [[float(len(t))] for t in texts]
    got = E.embed(spark.createDataFrame([("abc",), ("",)], "x string"), "x", lengths)
    assert rows(got) == [("", [0.0]), ("abc", [3.0])]


def test_readers_and_writers(spark, tmp_path):
    frame = notes(spark, [(1, "01", "Car", 3, 'first\nsays "yes", twice\n'), (2, "02", "Pul", 4, " x ")])
    W.write_note_extract(frame, str(tmp_path / "notes" / "car"))
    read = R.read_notes(spark, str(tmp_path / "notes"))
    assert rows(read, "empi", "text", "notedate") == rows(frame, "empi", "text", "notedate")
    assert read.select("note_id").distinct().count() == 2
    shards = spark.createDataFrame([(s, "t") for s in range(5)], "shard int, document string")
    W.write_embeddings(shards, str(tmp_path / "shards"), by=["shard"])
    assert R.read_sentence_shards(spark, str(tmp_path / "shards"), 1, 3).count() == 2
    assert R.read_sentence_shards(spark, str(tmp_path / "shards"), 1).count() == 4
    with pytest.raises(ValueError):
        R.read_sentence_shards(spark, str(tmp_path / "shards"), 7)
    lines = tmp_path / "raw.csv"
    lines.write_text("a b\n1.5\n")
    assert rows(R.read_term_lines(spark, str(lines))) == [("1.5",), ("a b",)]


def test_job_file():
    text = '{"SPAN_START": "0", "SPAN_END": "180", "NGRAMS_EXTRACT_ALL": "true", "K_TOPICS_LIST": ["5", "7"], "ALGORITHM": "ngram topic_model", "OUTPUT_ELEMENTS": "empi"}'
    config = JobConfig.from_json(text)
    assert (config.span_end, config.all_ngrams, config.topic_counts) == (180, True, (5, 7))
    assert config.algorithm == ("ngram", "topic_model")
    assert config.key_layout() == "empi"
    assert JobConfig(output_elements="?").key_layout() == "empi_expdate_notedate_diff_notetype"


def test_fixture_sizes(spark, sf):
    assert FX.cohort(spark, sf).count() == 150
    assert FX.notes(spark, sf).count() == 200
    assert FX.code_events(spark, sf).count() == 6000
    assert FX.mterms(spark, sf).count() == 6000


def test_jobs_and_writers_run_twice(spark, tmp_path):
    frame = blobs(spark)
    sets = [rows(PL.cluster_job(frame, 3, str(tmp_path / "c"))) for _ in range(2)]
    assert sets[0] == sets[1]
    features = spark.createDataFrame([("1", INDEX, "a", 3)], "empi string, expdate date, ngram string, span int")
    for n in (1, 2, 1):
        W.write_ngram_features(features, str(tmp_path / "n"), n)
    assert R.read_ngrams(spark, str(tmp_path / "n"), 1).count() == 1
    assert R.read_ngrams(spark, str(tmp_path / "n"), 2).count() == 1


def test_a_loaded_topic_model_keeps_its_vocabulary(spark, tmp_path):
    rng = random.Random(5)
    pool = ["heart", "valve", "aorta", "pulse", "lung", "cough", "asthma", "sputum", "liver", "spleen"]
    data = [(i, str(i % 6), "Car", i % 300, " ".join(rng.choices(pool, k=3))) for i in range(80)]
    first = notes(spark, data)
    PL.topic_job(first, JobConfig(), 2, str(tmp_path))
    later = notes(spark, [(i, e, t, d, x.replace("heart", "kidney")) for i, e, t, d, x in data])
    assert PL.topic_job(later, JobConfig(), 2, str(tmp_path)).count() == 80
    words = {r["term"] for r in spark.read.parquet(f"{tmp_path}/k=2/topic_terms").collect()}
    assert "kidney" not in words and words <= set(pool)


def test_topic_features_ask_the_model_once_a_note(spark):
    data = [(i, "1", "2020-01-01", "2020-01-01", "Car", 1, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(8)]
    names = "note_id long, empi string, expdate string, notedate string, notetype string, days int, tokens array<string>"
    vectors = TP.vectorised(spark.createDataFrame(data, names), ["a", "b", "c", "d"])
    given = TP.contributions(TP.fit_topics(vectors, 2, 1), vectors)
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(TP.as_features(given)).count("UDF(") == plan(given).count("UDF(") > 0


def test_terms_are_counted_inside_their_note(spark):
    names = "note_id long, tokens array<string>"
    kept = spark.createDataFrame([("a",), ("b",)], "term string")
    data = [(1, ["b", "a", "b", "c"]), (2, ["a"]), (3, []), (4, None), (5, ["c"]), (6, ["a", None, "a"])]
    found = TP.bag_of_words(spark.createDataFrame(data, names), kept)
    assert rows(found) == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (6, "a", 2)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    again = [(None, ["a", "b"]), (None, ["b"]), (2, ["a", "a"])]
    found = TP.bag_of_words(spark.createDataFrame(data + again, names), kept)
    assert rows(found) == sorted(
        [(1, "a", 1), (1, "b", 2), (2, "a", 3), (6, "a", 2), (None, "a", 1), (None, "b", 2)], key=repr
    )
