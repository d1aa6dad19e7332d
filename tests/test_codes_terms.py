from __future__ import annotations

import pytest
from helpers import INDEX, cohort, day, mentions, rows
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.operators import codes as CO
from covaria.operators import matrix as M
from covaria.operators import terms as T
from covaria.plans import jobs as PL
from covaria.plans.catalogue import QUERIES
from covaria.sources import fixtures as FX


def events(spark):
    data = [("1", day(3), "c1", "mcr"), ("1", day(4), "c1", "mcr"), ("1", day(3), "c1", "mcr_rpdr"),
            ("1", day(-1), "c2", "mcr"), ("2", day(365), "c2", "rpdr"), ("2", day(366), "c3", "mcr")]
    return spark.createDataFrame(data, "empi string, event_date date, code string, source string")


def test_code_frequency_by_dimension(spark):
    members = cohort(spark, ["1", "2", "3"])
    got = {d: rows(CO.code_frequency(members, events(spark), d), "empi", "source", "code", "n") for d in CO.DIMENSIONS}
    assert got["claims"] == [("1", "mcr", "c1", 2)]
    assert got["rpdr"] == [("1", "mcr_rpdr", "c1", 1), ("2", "rpdr", "c2", 1)]
    assert got["combined"] == got["claims"] + got["rpdr"]
    with pytest.raises(ValueError):
        CO.code_dimension(F.col("source"), "other")


def test_code_checks(spark):
    members = cohort(spark, ["1", "2", "3"])
    frequency = CO.code_frequency(members, events(spark), "combined")
    assert rows(CO.repeated_covariates(frequency), "empi", "code", "listed") == [("1", "c1", 2)]
    assert CO.checked_binary(CO.binary_codes(frequency)).count() == 3
    wide = M.attach(members, CO.codes_wide(frequency, ["c1", "c2"]))
    cells = CO.codes_long(wide)
    assert cells.count() == 6
    values = cells.select(K.positive_to_one(F.col("n")).alias("value"))
    assert rows(CO.not_binary(values)) == [(4, 6)]
    with pytest.raises(Exception, match="not all covariates"):
        CO.checked_binary(values).collect()


MENTIONS = [
    (1, "Problem", "Pain", 0, 0, "C1"),
    (1, "Problem", "Pain", 1, 0, "C1"),
    (1, "Problem", "Pain", 0, 1, "C2"),
    (1, "Problem", "Pain", None, 0, "C2"),
    (1, "Allergy", "a.5.b", 0, 0, ""),
    (1, "Other", None, 0, 0, "C9"),
    (9, "Problem", "Pain", 0, 0, "C1"),
]


def test_tags_and_names(spark):
    got = rows(T.tagged(mentions(spark, MENTIONS)), "noteID", "concept_tags", "term_names", "clean_terms", "clean_concept_tags")
    assert got[0][1:] == ("concept_C1", "term_Problem_Pain", "term_problem_pain", "concept_c1")
    assert got[4][1:3] == ("concept_NA", "term_Allergy_a_symbol_decimal_5.b")
    assert got[4][4] == "concept_na"
    assert got[5][1:] == ("NA", "term_Other_NA", "term_other_na", "na")
    sources = mentions(spark, [(1, m, "x", 0, 0, None) for m in T.CONCEPT_COLUMNS])
    assert {r[0] for r in rows(T.tagged(sources), "concept_tags")} == {"concept_NA"}


def test_indicators_follow_the_assertion(spark):
    tagged = T.tagged(T.of_cohort(cohort(spark, ["1"]), mentions(spark, MENTIONS)))
    term = T.indicators(tagged).where("feature = 'term_problem_pain'")
    assert rows(term, "indicator") == [(0,), (0,), (1,), (None,)]
    literal = T.indicators(tagged, "literal").where("feature = 'term_problem_pain'")
    assert rows(literal, "indicator") == [(1,), (1,), (1,), (1,)]


def test_frequency_and_binary(spark):
    members = cohort(spark, ["1", "2"])
    frequency = T.term_frequency(members, mentions(spark, MENTIONS))
    got = {(r["empi"], r["feature"]): r["frequency"] for r in frequency.collect()}
    assert got[("1", "term_problem_pain")] == 1
    assert got[("1", "concept_c1")] == 1
    assert got[("1", "concept_c2")] == 0
    assert got[("2", "term_na")] == got[("2", "concept_na")] == 1
    assert ("9", "term_problem_pain") not in got
    binary = {(r["empi"], r["feature"]): r["value"] for r in T.term_binary(frequency).collect()}
    assert binary == {k: int(v > 0) for k, v in got.items()}
    assert rows(T.no_terms(members, mentions(spark, MENTIONS)), "empi") == [("2",)]


def test_other_index_date_does_not_count(spark):
    other = mentions(spark, [(1, "Problem", "Pain", 0, 0, "C1")]).withColumn("expdate", F.date_add("expdate", 1))
    assert T.of_cohort(cohort(spark, ["1"]), other).count() == 0


def test_modes(spark):
    data = [(1, "ade", "b", 0, 0, "x"), (1, "ade", "a", 0, 0, "x"), (1, "Problem", None, None, 0, "y"),
            (1, "Problem", None, None, 0, "y"), (1, "Problem", "a", 1, 0, "z"), (2, "ade", "t", 0, 0, "q")]
    rows_in = T.of_cohort(cohort(spark, ["1", "2"]), mentions(spark, data))
    got = rows(T.participant_modes(rows_in, ["module", "term", "negated_mod", "noteID", "notedate"]))
    assert got[0] == ("1", INDEX, "Problem", "NA", None, 0, day(1))
    summary = {r["empi"]: r for r in T.module_summary(T.tagged(rows_in)).collect()}
    assert summary["1"]["most_frequent_ade_term_orig"] == "a"
    assert summary["1"]["concept_ade_module_entries"] == 2
    assert summary["1"]["most_frequent_problem_term_orig"] == "NA"
    assert summary["1"]["most_frequent_problem_concept_orig"] == "y"
    assert summary["2"]["term_problem_module_entries"] is None


def test_missing_summary(spark):
    members = cohort(spark, ["1", "2"])
    tagged = T.tagged(T.of_cohort(members, mentions(spark, MENTIONS)))
    assert rows(T.missing_summary(members, tagged), "empi", "missing_concept", "missing_term", "total_entries") == [
        ("1", 1, 0, 6),
        ("2", None, 1, 0),
    ]


def test_group_selection(spark):
    data = mentions(spark, [(i, "ade", "x", 0, 0, "c") for i in range(4)])
    pathed = data.withColumn(
        "path", F.concat(F.when(F.col("key") < 2, "Medicaid").otherwise("Medicare"), F.lit("/g"), F.col("key") % 2)
    )
    groups = {"Medicaid": {"ppi": "g0"}, "Medicare": {"ppi": "g1", "avr": "g1"}}
    files = ["d/max_x/ppi/a.csv", "d/mcr_x/avr/a.csv", "d/max_x/other/a.csv"]
    chosen = T.select_groups(pathed, F.col("path"), files, groups, "g1")
    assert rows(chosen, "dataset", "cohort", "key") == [
        ("Medicaid", "other", 1), ("Medicaid", "ppi", 0), ("Medicare", "avr", 3)
    ]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_wide_long_round_trip_and_sparse(spark):
    data = [("1", INDEX, "f", "a", 1.0), ("1", INDEX, "f", "b", 2.0), ("2", INDEX, "f", "b", 3.0), ("3", INDEX, "g", "a", 4.0)]
    long = spark.createDataFrame(data, "empi string, expdate date, family string, feature string, value double")
    one = long.where("family = 'f'").drop("family")
    back = M.long(M.wide(one, ["a", "b"], F.first("value")))
    assert rows(back) == rows(one)
    filled = M.attach(cohort(spark, ["1", "9"]), M.wide(one, ["a", "b"], F.first("value")), fill=0.0)
    assert rows(filled, "empi", "a", "b") == [("1", 1.0, 2.0), ("9", 0.0, 0.0)]
    index = M.feature_index(long)
    assert rows(index, "family", "feature", "id") == [("f", "a", 0), ("f", "b", 1), ("g", "a", 2)]
    full = M.covariate_rows(cohort(spark, ["1", "2", "3", "4"]), long, index)
    assert rows(full, "empi", "indices", "values") == [
        ("1", [0, 1], [1.0, 2.0]), ("2", [1], [3.0]), ("3", [2], [4.0]), ("4", [], [])
    ]
    assert rows(M.matrix_size(long)) == [(3, 3)]


def test_modes_move_rows_once_and_spread_hot_participants(spark, monkeypatch):
    monkeypatch.setattr(T, "MENTIONS_PER_TASK", 2)
    data = [(1, "ade", "b" if i % 3 else "a", 0, None, "x") for i in range(90)]
    data += [(k, "Problem", t, 1, 0, None) for k in range(2, 5) for t in ("d", "c")]
    frame = T.tagged(mentions(spark, data).withColumn("empi", F.col("key").cast("string")))
    modes = T.participant_modes(frame, ["term", "negated_mod", "family_history_mod", "rxcui", "notedate"])
    want = [("1", INDEX, "b", 0, None, "x", day(1)), *[(str(k), INDEX, "c", 1, 0, "NA", day(1)) for k in range(2, 5)]]
    assert rows(modes) == want
    summary = T.module_summary(frame).select("empi", "term_ade_module_entries", "most_frequent_problem_term_orig")
    assert rows(summary) == [("1", 90, None), ("2", None, "c"), ("3", None, "c"), ("4", None, "c")]
    assert "REPARTITION_BY_NUM" in modes._jdf.queryExecution().executedPlan().toString()


def test_demographics_of_term_tables_are_made_once(spark, tmp_path, monkeypatch):
    made, whole = [], PL.term_demographics
    monkeypatch.setattr(PL, "term_demographics", lambda *given: made.append(1) or whole(*given))
    frame = mentions(spark, [(1, "ade", "a", 0, 0, "x")])
    for _ in range(2):
        tables = PL.term_tables(cohort(spark, ["1", "2"]), frame, str(tmp_path))
    assert made == [1] and tables.binary.count() == tables.frequency.count() == 4


def test_modes_add_names_after_the_rows_have_moved(spark, monkeypatch):
    data = [(k, "ade", t, 0, None, c) for k in (1, 2) for t, c in (("B.1 x", "x"), ("a", None), ("a", ""))]
    plain = mentions(spark, data).withColumn("empi", F.col("key").cast("string"))
    plain = plain.unionByName(plain.where("key = 2").withColumn("empi", F.lit(None).cast("string")))
    tag = T.tagger(plain)
    whole = tag(plain)
    columns = T.mode_columns(whole)
    want = rows(T.participant_modes(whole, columns)), rows(T.module_summary(whole))
    moved, repartition = [], type(plain).repartition
    monkeypatch.setattr(type(plain), "repartition", lambda df, *by: moved.append(df.columns) or repartition(df, *by))
    assert (rows(T.participant_modes(plain, columns, tag)), rows(T.module_summary(plain, tag))) == want
    assert len(moved) == 2 and not any({"term_names", "clean_terms"} & set(names) for names in moved)


def test_saved_term_tables_are_joined_by_their_rows_not_by_their_files(spark, sf):
    plan = QUERIES["term_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_mentions_meet_the_cohort_where_they_are(spark, sf):
    """Failed before: with a cohort too large for Spark's own broadcast all mentions were shuffled once more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = FX.mterms(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [empi" in plan and "SortMergeJoin [empi" not in plan
