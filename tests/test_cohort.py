from __future__ import annotations

import datetime as dt

from helpers import INDEX, cohort, day, notes, one, rows
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.operators import scale
from covaria.operators import cohort as C

EDGES = [(1, "1", "Car", -1, "a"), (2, "1", "Car", 0, "a"), (3, "1", "Car", 364, "a"), (4, "1", "Car", 365, "a")]


def test_window_edges(spark):
    frame = notes(spark, EDGES)
    assert rows(C.note_window(frame), "note_id") == [(2,), (3,)]
    assert rows(C.note_window(frame, mode="abs"), "note_id") == [(1,), (2,), (3,)]
    events = frame.select("note_id", "empi", "notedate")
    joined = C.cohort_join(cohort(spark, ["1"]), events, "notedate")
    assert rows(joined, "note_id") == [(2,), (3,), (4,)]


def test_shuffle_join_gives_the_same_rows_with_a_hot_patient(spark):
    many = [(i, "hot" if i % 3 else str(i), "Car", i % 400, "a") for i in range(900)]
    events = notes(spark, many).select("note_id", "empi", "notedate")
    members = cohort(spark, ["hot", *[str(i) for i in range(0, 900, 3)], "none"])
    wide = C.cohort_join(members, events, "notedate")
    tight = C.cohort_join(members, events, "notedate", limit_bytes=0)
    assert rows(wide, "note_id", "empi", "expdate") == rows(tight, "note_id", "empi", "expdate")
    assert wide.count() == sum(1 for i in range(900) if i % 400 <= 365)


def test_note_numbers_count_from_the_newest(spark):
    frame = notes(spark, [(1, "1", "Car", 40, "a"), (2, "1", "Car", 10, "a"), (3, "1", "Pul", 10, "a")])
    assert rows(C.flattened_notes(frame), "note_id", "note_number") == [(1, 2), (2, 0), (3, 1)]


def test_washout(spark):
    flagged = spark.createDataFrame(
        [("a", 0, 0, 0, 0, "x"), ("b", 0, 1, 0, 0, "x"), ("c", 1, 0, 0, 0, "x"), ("d", 1, 1, 1, 0, "x")],
        "empi string, prior365_treatment_flag int, prior365_comparator_flag int, "
        "prior180_treatment_flag int, prior180_comparator_flag int, that_form string",
    )
    kept = lambda df: [r[0] for r in rows(df, "empi")]
    assert kept(C.washout(flagged, 365)) == ["a"]
    assert kept(C.washout(flagged, 180)) == ["a", "b", "c"]
    assert kept(C.washout(flagged, repeated_measure=True)) == ["a", "b"]
    assert kept(C.washout(flagged, 0)) == ["a", "b", "c", "d"]
    assert "that_form" not in C.washout(flagged, 365).columns


def test_one_index_per_patient(spark):
    frame = spark.createDataFrame(
        [("a", INDEX, "1"), ("a", day(30), "2"), ("b", INDEX, "1")], "empi string, expdate date, outcome string"
    )
    assert rows(C.one_index_per_patient(frame)) == [("a", day(30), "2"), ("b", INDEX, "1")]


def test_keys(spark):
    got = rows(C.participant_keys(cohort(spark, ["007"])))
    assert got == [("007", INDEX, 17167, "00717167", "00701012007")]
    assert one(spark, "1", K.outcome_flag) == "1"
    assert one(spark, None, K.outcome_flag) == "0"
    offset = lambda x: K.index_date(x.cast("int"))
    assert one(spark, "31", offset) == dt.date(2007, 2, 1)


def test_coverage(spark):
    frame = notes(spark, [*EDGES, (5, "2", "Car", 900, "a")])
    assert rows(C.note_coverage(frame)) == [("1", 4, 3), ("2", 1, 0)]
    assert rows(C.coverage_totals(frame)) == [(2, 1, 3)]


def test_restrict_and_missing(spark):
    members = cohort(spark, ["1", "2"])
    frame = notes(spark, EDGES + [(9, "3", "Car", 1, "a")])
    assert rows(C.restrict_to_cohort(frame, members, ("empi",)).select("empi").distinct()) == [("1",)]
    assert rows(C.without_rows(members, frame, ("empi",)), "empi") == [("2",)]


def test_binarise(spark):
    cells = spark.createDataFrame([(0,), (2,), (None,)], "n int")
    got = [r[0] for r in cells.select(K.positive_to_one(F.col("n"))).collect()]
    assert got == [0, 1, None]


def test_fill_and_align(spark):
    frame = spark.createDataFrame([("a", None, None)], "empi string, note string, n int")
    assert rows(K.fill_missing(frame, number=0)) == [("a", "NA", 0)]
    target = spark.createDataFrame([(1.5,)], "n double")
    assert dict(K.align_types(frame, target).dtypes)["n"] == "double"
    assert K.key_first(frame, "n").columns == ["n", "empi", "note"]


def test_rows_that_lie_apart_already_are_not_moved(spark, tmp_path):
    tasks = spark.sparkContext.defaultParallelism
    spark.range(64).repartition(tasks).write.parquet(str(tmp_path / "many"))
    spark.range(64).coalesce(1).write.parquet(str(tmp_path / "one"))
    plan = lambda name: scale.spread(spark.read.parquet(str(tmp_path / name)), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan("one") and "Repartition" not in plan("many")
    assert scale.spread(spark.read.parquet(str(tmp_path / "one")).limit(0), "id").count() == 0
