from __future__ import annotations

import itertools
import random

import pytest
from helpers import INDEX, day, notes, rows
from pyspark.sql import functions as F

from covaria.operators import ngrams as N
from covaria.operators import scale
from covaria.operators.cohort import note_window

TWO = [(1, "1", "Car", 10, "h\nheart pain"), (2, "1", "Pul", 40, "h\nheart"), (3, "2", "Car", 5, "one line")]


def tokens(spark, data, preprocessor="nltk"):
    return N.tokenised(note_window(notes(spark, data)), preprocessor)


def spans(spark, layout, word="heart", data=TWO):
    found = N.token_presence(tokens(spark, data), 1, layout)
    return rows(found.where(f"ngram = '{word}'").drop("ngram"))


def test_layouts(spark):
    assert spans(spark, "empi") == [("1", 10)]
    assert spans(spark, "empi_expdate") == [("1", INDEX, 40)]
    assert spans(spark, "empi_expdate_notetype") == [("1", INDEX, "Car", 10), ("1", INDEX, "Pul", 40)]
    assert spans(spark, "empi_expdate_notedate") == [("1", INDEX, day(40), 40), ("1", INDEX, day(10), 10)]
    assert spans(spark, "empi_expdate_notedate_diff_notetype") == [
        ("1", INDEX, day(40), 40, "Pul", 40),
        ("1", INDEX, day(10), 10, "Car", 10),
    ]
    assert spans(spark, "comb_empi_expdate_notedate_diff_notetype")[0][0] == "101012007"


def test_same_type_keeps_the_oldest_span(spark):
    data = [(1, "1", "Car", 10, "h\nheart"), (2, "1", "Car", 40, "h\nheart")]
    assert spans(spark, "empi_expdate_notetype", data=data) == [("1", INDEX, "Car", 40)]


def test_counts_and_ties(spark):
    counts = N.ngram_counts(tokens(spark, [(1, "1", "Car", 1, "h\nbb aa cc cc")]), 1)
    assert rows(counts) == [("aa", 1), ("bb", 1), ("cc", 2)]
    assert rows(N.top_ngrams(counts, 2)) == [("aa", 1), ("cc", 2)]


def test_short_note_has_no_bigram(spark):
    one = tokens(spark, [(1, "1", "Car", 1, "h\nheart")])
    assert N.ngram_counts(one, 1).count() == 1
    assert N.ngram_counts(one, 2).count() == 0


def test_token_and_substring_match_differ(spark):
    frame = tokens(spark, [(1, "1", "Car", 3, "h\nheart"), (2, "2", "Car", 4, "h\nart")])
    art = spark.createDataFrame([("art",)], "ngram string")
    assert rows(N.token_presence(frame, 1, "empi", art), "empi") == [("2",)]
    assert rows(N.substring_presence(frame, 1, "empi", art), "empi") == [("1",), ("2",)]


@pytest.mark.parametrize("preprocessor", ["nltk", "raw"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_substring_match_equals_brute_force(spark, n, preprocessor):
    rng = random.Random(n)
    pieces = ["a", "ab", "ba", "bb", "abab", "-", "b-a", "x.y", "A", "\n"]
    data = [
        (i, str(i % 4), "Car", i % 30, "h\n" + " ".join(rng.choices(pieces, k=rng.randint(0, 7))))
        for i in range(60)
    ]
    frame = tokens(spark, data, preprocessor)
    chosen = N.select_features(frame, n, 1000)
    features = [r["ngram"] for r in chosen.collect()]
    got = rows(N.substring_presence(frame, n, "empi", chosen), "empi", "ngram", "span")
    best: dict = {}
    for row, feature in itertools.product(frame.collect(), features):
        if feature in row["body"]:
            key = (row["empi"], feature)
            best[key] = min(best.get(key, 999), row["days"])
    assert got == sorted(((e, f, d) for (e, f), d in best.items()), key=repr)


def test_longer_features_are_matched_where_the_notes_are(spark, monkeypatch):
    frame = tokens(spark, [(1, "1", "Car", 3, "h\nart beat xart beating"), (2, "2", "Car", 4, "h\nart")])
    two = spark.createDataFrame([("art beat",), ("art b",), ("rt beati",), ("xart x",)], "ngram string")

    def staged(*_):
        raise AssertionError("chunks are written and shuffled")

    monkeypatch.setattr(scale, "staged", staged)
    found = rows(N.substring_presence(frame, 2, "empi", two), "empi", "ngram")
    assert found == [("1", "art b"), ("1", "art beat"), ("1", "rt beati")]


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams_are_made_in_compiled_code(spark, n):
    frame = tokens(spark, [(1, "1", "Car", 3, "h\nx q x q x"), (2, "2", "Car", 4, "h\nx"), (3, "2", "Car", 4, "h")])
    counts = N.ngram_counts(frame.select("tokens"), n)
    assert rows(counts) == ([("q x", 2), ("x q", 2)] if n == 2 else [("q x q", 1), ("x q x", 2)])
    chosen = counts.where("n = 2").select("ngram")
    found = N.token_presence(frame, n, "empi", chosen)
    assert rows(found, "empi", "ngram") == [("1", g) for g in (["q x", "x q"] if n == 2 else ["x q x"])]
    for made in (counts, found):
        assert "zip_with" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_totals_and_unknown_preprocessor(spark):
    presence = N.token_presence(tokens(spark, TWO), 1, "empi_expdate")
    assert rows(N.feature_totals(presence)) == [(1, 2)]
    with pytest.raises(ValueError):
        tokens(spark, TWO, "other")


def test_result_does_not_depend_on_partitions_or_order(spark):
    rng = random.Random(7)
    data = [
        (i, str(i % 5), rng.choice(["Car", "Pul"]), rng.randint(0, 300), "h\n" + " ".join(rng.choices("abcde", k=9)))
        for i in range(80)
    ]
    results = []
    for parts, seed in ((3, 1), (17, 2)):
        random.Random(seed).shuffle(data)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        frame = tokens(spark, data)
        chosen = N.select_features(frame, 2, 10)
        results.append(rows(N.token_presence(frame, 2, "empi_expdate", chosen)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_salted_joins_keep_every_row(spark):
    big = spark.range(2000).selectExpr("if(id % 3 = 0, id, 0) as k", "id")
    other = spark.range(0, 2000, 2).selectExpr("id as k", "id * 10 as v")
    for how in ("inner", "left", "left_semi"):
        salted = scale.salted_join(big, other, ["k"], big["id"], how, shares=8)
        assert rows(salted) == rows(big.join(other, "k", how))
    with pytest.raises(ValueError):
        scale.salted_join(big, other, ["k"], big["id"], "full")


def test_hot_keys_fill_their_share(spark):
    big = spark.range(2000).selectExpr("if(id % 3 = 0, id, -1) as k", "id")
    assert rows(scale.hot_keys(big, ["k"], 8)) == [(-1, 6)]
    assert scale.hot_keys(spark.range(2000), ["id"], 64).count() == 0


def test_rows_without_a_key_are_kept(spark):
    big = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as k", "id")
    other = spark.range(0, 300, 2).selectExpr("id as k", "id * 10 as v")
    for how in ("inner", "left"):
        salted = scale.salted_join(big, other, ["k"], F.col("id"), how, shares=8)
        assert rows(salted) == rows(big.join(other, "k", how))


def test_numbers_of_a_hot_group(spark):
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, id, -1) as k", "id")
    got = scale.numbered(frame, ["k"], [F.col("id").desc()], "rn")
    hot = [r["id"] for r in got.where("k = -1").orderBy("rn").collect()]
    assert hot == sorted((i for i in range(3000) if i % 3), reverse=True)
    assert got.where("k >= 0 and rn != 0").count() == 0


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


class FakeSession:
    def __init__(self, master):
        self.sparkContext, self.conf = FakeContext(master), {}


def test_only_a_local_session_may_lack_the_shared_folder(spark):
    assert scale.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    local = FakeSession("local[2]")
    assert scale.shared_dir(local) == scale.shared_dir(local) == local.sparkContext.folder
    with pytest.raises(ValueError):
        scale.shared_dir(FakeSession("spark://host:7077"))


def test_held_bytes(spark):
    assert scale.held_bytes(spark.range(10)) == 10 * 32
    assert not scale.small(spark.range(10), 100)
    texts = spark.createDataFrame([("ab", [1, 2]), (None, None)], "t string, a array<int>")
    assert scale.held_bytes(texts) == 2 * 48 + 2 + len("[1, 2]")


def test_ngrams_found_once_are_written_only_when_wanted(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i:02d}", n) for i, n in enumerate([5, 1, 3, 3, 3, 1, 7, 1])], "ngram string, n long")
    written, staged = [], N.scale.staged
    monkeypatch.setattr(N.scale, "staged", lambda df, name, *by: written.append(df.count()) or staged(df, name, *by))
    got = lambda k: sorted(r["ngram"] for r in N.top_ngrams(counts, k).collect())
    assert got(4) == ["w00", "w02", "w03", "w06"] and written == [5]
    assert got(6) == ["w00", "w01", "w02", "w03", "w04", "w06"] and written[1:] == [5, 3]
    assert len(got(9)) == 8 and got(5) == ["w00", "w02", "w03", "w04", "w06"]
