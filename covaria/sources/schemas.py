"""Pinned schemas of the input files."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _DATE = T.StringType(), T.LongType(), T.DateType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


# Columns of a note extract, in file order.
NOTES = _struct(
    ("p_id", _STRING),
    ("expdate", _DATE),
    ("empi", _STRING),
    ("outcome", _STRING),
    ("notetype", _STRING),
    ("notedate", _DATE),
    ("text", _STRING),
)

# Columns of a term file, in file order.
MTERMS = _struct(
    ("key", _LONG),
    ("noteID", _LONG),
    ("expdate", _DATE),
    ("notedate", _DATE),
    ("diffdays", _LONG),
    ("module", _STRING),
    ("term", _STRING),
    ("section_text", _STRING),
    ("negated_mod", _LONG),
    ("family_history_mod", _LONG),
    ("concept_id", _STRING),
    ("SNOMED_PrefTerm", _STRING),
    ("rxcui", _STRING),
    ("Frequencies", _STRING),
    ("dispense_amounts", _STRING),
    ("drug_status", _STRING),
    ("drug_strenths", _STRING),
    ("drug_durations", _STRING),
    ("drug_forms", _STRING),
    ("drug_intake_times", _STRING),
    ("drug_routes", _STRING),
    ("necessities", _STRING),
    ("refills", _STRING),
    ("UMLS_CUI", _STRING),
    ("ProblemCategory", _STRING),
    ("ICD_Hierarchy", _STRING),
)

TOPIC_STRINGS = _struct(
    ("empi", _STRING),
    ("expdate", _DATE),
    ("notedate", _DATE),
    ("diff", T.IntegerType()),
    ("notetype", _STRING),
    ("topic_contributions", _STRING),
)
