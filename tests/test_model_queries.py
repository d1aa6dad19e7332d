"""What must hold of the rows of queries that no SQL can state: fitted models."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from covaria.operators import clusters as CL
from covaria.operators import topics as TP
from covaria.plans.catalogue import QUERIES
from covaria.sources import fixtures as FX


def collected(spark, sf, name):
    found = QUERIES[name](spark, sf).collect()
    assert found
    return found


@pytest.fixture(scope="module")
def vocabulary(spark, sf):
    return {r["term"] for r in QUERIES["document_frequency"](spark, sf).collect()}


def test_topic_words_are_of_the_vocabulary_in_order_of_weight(spark, sf, vocabulary):
    topics = defaultdict(list)
    for r in collected(spark, sf, "fit_topics"):
        topics[r["topic"]].append((r["rank"], r["term"], r["weight"]))
    assert sorted(topics) == list(range(5))
    for words in topics.values():
        words.sort()
        assert [w[0] for w in words] == list(range(1, min(20, len(vocabulary)) + 1))
        assert {w[1] for w in words} <= vocabulary and len({w[1] for w in words}) == len(words)
        assert [w[2] for w in words] == sorted((w[2] for w in words), reverse=True)


def test_topics_are_ranked_by_coherence(spark, sf, vocabulary):
    found = sorted(collected(spark, sf, "topic_terms"))
    assert [r["topic_rank"] for r in found] == [1, 2, 3, 4, 5]
    assert [r["coherence"] for r in found] == sorted((r["coherence"] for r in found), reverse=True)
    assert all(set(r["words"].split(", ")) <= vocabulary for r in found)


def test_contributions_fall_and_sum_to_one_at_most(spark, sf):
    found = collected(spark, sf, "topic_contributions")
    assert {r["note_id"] for r in found} == {r["note_id"] for r in QUERIES["note_window_signed"](spark, sf).collect()}
    for r in found:
        weights = [w for _, w in r["topic_contributions"]]
        assert weights == sorted(weights, reverse=True) and min(weights, default=1) >= TP.MIN_WEIGHT and sum(weights) <= 1 + 1e-9


def test_bounds_and_reports(spark, sf):
    (bound,) = collected(spark, sf, "log_perplexity")
    assert -100 < bound["bound"] < 0
    metrics = {(r["metric"], r["topic"]): r["value"] for r in collected(spark, sf, "topic_metrics")}
    measures = ("u_mass", "c_v", "c_uci", "c_npmi")
    assert set(metrics) == {(m, t) for m in measures for t in range(-1, 5)} | {("log_perplexity", -1)}
    for m in measures:
        assert metrics[m, -1] == pytest.approx(np.mean([metrics[m, t] for t in range(5)]))
    swept = collected(spark, sf, "topic_sweep")
    assert [r["k"] for r in swept] == [3, 5] and all(-100 < r["log_perplexity"] < 0 >= r["coherence"] for r in swept)


def test_clusters(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in FX.vectors(spark, sf).collect()}
    given = {r["vec_id"]: r["cluster"] for r in collected(spark, sf, "fit_clusters")}
    assert given.keys() == vectors.keys() and set(given.values()) == set(range(10))
    members = defaultdict(list)
    for vec, cluster in given.items():
        members[cluster].append(vectors[vec])
    centres = np.array([np.mean(members[c], axis=0) for c in range(10)])
    cost = sum(((v - centres[given[i]]) ** 2).sum() for i, v in vectors.items())
    whole = np.array(list(vectors.values()))
    spread = ((whole - whole.mean(axis=0)) ** 2).sum()
    moved = sum(np.argmin(((centres - v) ** 2).sum(axis=1)) != given[i] for i, v in vectors.items())
    assert cost < 0.98 * spread and moved <= 0.02 * len(vectors)
    sets = collected(spark, sf, "cluster_job")
    assert all(set(r["cluster"]) <= set(range(10)) and r["positive_cluster_num"] == len(r["cluster"]) for r in sets)
    assert {r["cluster"] for r in collected(spark, sf, "reuse_models")} == set(range(5))


def test_cost_falls_with_the_number_of_clusters(spark, sf):
    found = sorted(collected(spark, sf, "cluster_sweep"))
    assert [r["k"] for r in found] == sorted(k for k in CL.CLUSTER_COUNTS if k <= max(r["clusters"] for r in found))
    costs = [r["cost"] for r in found]
    assert costs == sorted(costs, reverse=True) and all(c >= 0 for c in costs)


def test_word_vectors(spark, sf):
    found = collected(spark, sf, "embed_word2vec")
    assert {len(r["embedding"]) for r in found} == {16} and np.isfinite([r["embedding"] for r in found]).all()
    sentences = collected(spark, sf, "embed_sentences")
    assert {len(r["embedding"]) for r in sentences} == {16}
    assert max(np.linalg.norm(r["embedding"]) for r in sentences) <= 1 + 1e-9


def test_modelled_covariates(spark, sf):
    found = collected(spark, sf, "covariates_modelled")
    assert {r["family"] for r in found} == {"topic", "sentence_cluster"}
    assert all(TP.MIN_WEIGHT <= r["value"] <= 1 and r["feature"].rsplit("_", 1)[1].isdigit() for r in found)


def test_fitted_clusters_are_those_of_the_nearest_centres(spark, sf):
    found = collected(spark, sf, "fit_clusters")
    assert len(found) == FX.vectors(spark, sf).count() and all(r["nearest"] for r in found)
