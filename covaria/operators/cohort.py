"""Cohort selection and the notes or events inside its look-back window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.operators import scale

LOOK_BACK_DAYS = 365
# Columns dropped from a cohort file before modelling.
HELPER_COLUMNS = ("Variables", "that_form", "participantID")


def washout(cohort: DataFrame, days: int = 365, repeated_measure: bool = False) -> DataFrame:
    """Participants without the treatment (or its comparator) in the days before the index.

    Repeated-measure cohorts only ask for no treatment in the last 365 days. A
    window other than 365 or 180 keeps everybody.
    """
    if repeated_measure:
        kept = cohort.where(F.col("prior365_treatment_flag") == 0)
    elif days in (365, 180):
        kept = cohort.where(
            (F.col(f"prior{days}_treatment_flag") == 0)
            & (F.col(f"prior{days}_comparator_flag") == 0)
        )
    else:
        return cohort
    return kept.drop(*HELPER_COLUMNS)


def one_index_per_patient(cohort: DataFrame) -> DataFrame:
    """Keep each patient's earliest index date."""
    others = [c for c in cohort.columns if c != "empi"]
    first = F.min_by(F.struct(*others), F.struct("expdate", *others))
    return cohort.groupBy("empi").agg(first.alias("row")).select("empi", "row.*")


def participant_keys(cohort: DataFrame) -> DataFrame:
    """The key forms used by the feature files of each family."""
    empi, expdate = F.col("empi"), F.col("expdate")
    return cohort.select(
        empi.cast("string").alias("empi"),
        "expdate",
        K.sas_date(expdate).alias("sas_date"),
        K.empi_indexdt(empi, expdate).alias("empi_indexdt"),
        K.empi_exp_date(empi, expdate).alias("empi_exp_date"),
    )


def _in_look_back(event_date: Column, days: int) -> Column:
    return event_date.between(F.date_sub("expdate", days), F.col("expdate"))


def cohort_join(
    cohort: DataFrame,
    events: DataFrame,
    event_date: str,
    days: int = LOOK_BACK_DAYS,
    limit_bytes: int = scale.BROADCAST_BYTES,
) -> DataFrame:
    """Events of cohort members in the ``days`` up to the index date, both ends included.

    The cohort is broadcast when it fits, so that note text is never shuffled.
    Otherwise both sides are shuffled on the patient, hot patients in several tasks.
    """
    spread_by = F.struct(*[c for c in events.columns if c != "empi"])
    joined = scale.sized_join(events, cohort, ["empi"], spread_by, "inner", limit_bytes)
    return joined.where(_in_look_back(F.col(event_date), days))


def note_window(
    notes: DataFrame, start: int = 0, end: int = LOOK_BACK_DAYS, mode: str = "signed"
) -> DataFrame:
    """Notes with ``start <= days < end``, where ``days`` runs from the note to the index date.

    ``abs`` measures in both directions and so also keeps notes after the index date.
    """
    days = K.day_span(F.col("expdate"), F.col("notedate"))
    measured = {"signed": days, "abs": F.abs(days)}[mode]
    return notes.where((measured >= start) & (measured < end)).withColumn("days", days)


def flattened_notes(
    notes: DataFrame, start: int = 0, end: int = LOOK_BACK_DAYS
) -> DataFrame:
    """One row per note in the window, with its number counted from the newest."""
    inside = note_window(notes, start, end)
    order = [F.col("notedate").desc(), F.col("note_id").asc()]
    numbers = scale.numbered(
        inside.select("empi", "expdate", "notedate", "note_id"), ["empi", "expdate"], order, "note_number"
    )
    rows = inside.select(
        "note_id",
        "empi",
        "expdate",
        "notedate",
        F.abs("days").alias("diffdays"),
        "notetype",
        F.col("outcome").alias("Outcome"),
        "text",
    )
    return rows.join(numbers.select("note_id", "empi", "expdate", "note_number"), ["note_id", "empi", "expdate"])


def note_coverage(notes: DataFrame, start: int = 0, end: int = LOOK_BACK_DAYS) -> DataFrame:
    """Notes per patient and how many of them lie in the (absolute) window."""
    days = F.abs(K.day_span(F.col("expdate"), F.col("notedate")))
    inside = (days >= start) & (days < end)
    return notes.groupBy("empi").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(inside).alias("notes_in_window")
    )


def coverage_totals(notes: DataFrame, start: int = 0, end: int = LOOK_BACK_DAYS) -> DataFrame:
    """Patients with any note, patients with a note in the window, and those notes."""
    return note_coverage(notes, start, end).agg(
        F.count(F.lit(1)).alias("patients_with_note"),
        F.count_if(F.col("notes_in_window") > 0).alias("patients_in_window"),
        F.coalesce(F.sum("notes_in_window"), F.lit(0)).alias("notes_in_window"),
    )


def restrict_to_cohort(rows: DataFrame, cohort: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose key is in the cohort."""
    others = [c for c in rows.columns if c not in keys]
    members = cohort.select(*keys).distinct()
    return scale.sized_join(rows, members, list(keys), F.struct(*others), "left_semi")


def without_rows(cohort: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cohort members with no row at all."""
    return cohort.join(rows.select(*keys).distinct(), list(keys), "left_anti")
