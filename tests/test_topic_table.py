from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from covaria.operators import scale
from covaria.operators import topic_table as TT


def bag_rows():
    rng = random.Random(4)
    return [(n, f"w{w}", rng.randint(1, 4)) for n in range(30) for w in rng.sample(range(25), rng.randint(1, 12))]


def held(spark, rows):
    return spark.createDataFrame(rows, "note_id long, term string, tf long")


def shares(theta, weights, tf):
    product = [a * b for a, b in zip(theta, weights)]
    return [tf * x / sum(product) for x in product]


def normal(sums, alpha):
    smooth = [x + alpha for x in sums]
    return [x / sum(smooth) for x in smooth]


def brute_fit(rows, first, k, steps):
    topics, notes = dict(first), {n: [1 / k] * k for n, _, _ in rows}
    for _ in range(steps):
        by_term, by_note = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k)
        for n, term, tf in rows:
            for i, x in enumerate(shares(notes[n], topics[term], tf)):
                by_term[term][i] += x
                by_note[n][i] += x
        totals = [sum(v[i] + 0.01 for v in by_term.values()) for i in range(k)]
        topics = {t: [(x + 0.01) / y for x, y in zip(v, totals)] for t, v in by_term.items()}
        notes = {n: normal(v, 1 / k) for n, v in by_note.items()}
    return topics, notes


def close(got, want):
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-12)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("k", [1, 3, 70])
def test_fit_equals_brute_force(spark, monkeypatch, k, few):
    monkeypatch.setattr(scale, "small", lambda *_: few)
    rows = bag_rows()
    terms = held(spark, rows).select("term").distinct()
    begun = TT._first_terms(terms, k).collect()
    first = {r["term"]: [r[f"_weight{i}"] for i in range(k)] for r in begun}
    topics, notes = TT.fit(held(spark, rows), k, 2)
    want_topics, want_notes = brute_fit(rows, first, k, 2)
    close({r["term"]: r["weights"] for r in topics.collect()}, want_topics)
    close({r["note_id"]: r["theta"] for r in notes.collect()}, want_notes)


def test_a_step_writes_no_table_of_words(spark, monkeypatch):
    """Failed before: each step wrote the topics' shares of every word of every note."""
    written, staged = [], scale.staged
    monkeypatch.setattr(scale, "staged", lambda df, name, *by: written.append(name) or staged(df, name, *by))
    TT.fit(held(spark, bag_rows()), 3, 2)
    assert "shares" not in written


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_fold_in_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(TT, "MOST_CELLS", cells)
    rows = bag_rows()
    rng = random.Random(6)
    weights = {f"w{i}": [rng.random() for _ in range(3)] for i in range(20)}
    topics = spark.createDataFrame(list(weights.items()), "term string, weights array<double>")
    want = {}
    for note in {n for n, _, _ in rows}:
        words = [(t, tf) for n, t, tf in rows if n == note and t in weights]
        theta = [1 / 3] * 3
        for _ in range(4):
            parts = [shares(theta, weights[t], tf) for t, tf in words]
            theta = normal([sum(p[i] for p in parts) for i in range(3)], 1 / 3)
        if words:
            want[note] = theta
    folded = TT.fold_in(held(spark, rows), topics, 3, 4)
    close({r["note_id"]: r["theta"] for r in folded.collect()}, want)
    # Failed before: the steps were nested loops over arrays, interpreted cell by cell.
    assert "MapInArrow" in folded._jdf.queryExecution().executedPlan().toString()


def test_fold_in_of_no_notes(spark):
    topics = spark.createDataFrame([("a", [0.5, 0.5])], "term string, weights array<double>")
    assert TT.fold_in(held(spark, [(1, "b", 1)]), topics, 2, 4).count() == 0
    assert TT.fold_in(held(spark, [(None, "a", 1)]), topics, 2, 4).collect() == [(None, [0.5, 0.5])]


def test_words_are_not_joined_to_a_table_of_notes(spark, monkeypatch):
    """Failed before: notes too many for a broadcast were joined to their words anew in each step."""
    rows = bag_rows() + [(None, "w1", 3), (None, "only", 1), (3, "w1", 2), (3, "w1", 2)]
    bag = held(spark, rows)
    begun = TT._first_terms(bag.select("term").distinct(), 3)
    joined, join = [], scale.salted_join
    monkeypatch.setattr(scale, "small", lambda df, *_: "note_id" not in df.columns)
    monkeypatch.setattr(scale, "salted_join", lambda *given: joined.append(given[2]) or join(*given))
    topics, notes = TT.fit(bag, 3, 3)
    first = {r["term"]: [r[f"_weight{i}"] for i in range(3)] for r in begun.collect()}
    want_topics, want_notes = brute_fit([r for r in rows if r[0] is not None], first, 3, 3)
    close({r["term"]: r["weights"] for r in topics.collect()}, want_topics)
    close({r["note_id"]: r["theta"] for r in notes.collect()}, want_notes)
    found = TT.log_perplexity(bag, topics, notes).first()
    inside = [(n, t, tf) for n, t, tf in rows if n is not None]
    logs = [tf * math.log(sum(a * b for a, b in zip(want_notes[n], want_topics[t]))) for n, t, tf in inside]
    assert joined == [] and found["words"] == sum(tf for _, _, tf in inside)
    assert found["bound"] == pytest.approx(sum(logs) / found["words"], abs=1e-12)


def test_folded_notes_move_without_weights(spark):
    """Failed before: each word was shuffled with a weight for every topic."""
    topics = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.2, 0.8])], "term string, weights array<double>")
    plan = TT.fold_in(held(spark, bag_rows()), topics, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "weights" not in plan
