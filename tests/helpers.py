from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

INDEX = dt.date(2007, 1, 1)


def day(back: int) -> dt.date:
    return INDEX - dt.timedelta(days=back)


def notes(spark, rows):
    """Rows of (note_id, empi, notetype, days back, text) at one index date."""
    full = [(i, e, "p" + e, INDEX, "0", t, day(b), x) for i, e, t, b, x in rows]
    return spark.createDataFrame(
        full,
        "note_id bigint, empi string, p_id string, expdate date, outcome string, "
        "notetype string, notedate date, text string",
    )


def mentions(spark, rows):
    """Rows of (key, module, term, negated, family, code) at one index date."""
    full = [
        (k, i, INDEX, day(1), m, t, n, f, c, c, c, c) for i, (k, m, t, n, f, c) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "key bigint, noteID bigint, expdate date, notedate date, module string, term string, "
        "negated_mod int, family_history_mod int, concept_id string, SNOMED_PrefTerm string, "
        "rxcui string, UMLS_CUI string",
    )


def cohort(spark, names):
    return spark.createDataFrame([(n, INDEX) for n in names], "empi string, expdate date")


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def one(spark, value, expression):
    """Evaluate a column expression on one string."""
    frame = spark.createDataFrame([(value,)], "x string")
    return frame.select(expression(F.col("x")).alias("y")).first()["y"]
