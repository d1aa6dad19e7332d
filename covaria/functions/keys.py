"""Date, key and null expressions shared by every feature family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Day zero of the SAS calendar and the study's base date.
SAS_EPOCH = "1960-01-01"
STUDY_BASE_DATE = "2007-01-01"


def sas_date(day: Column) -> Column:
    """Days since 1960-01-01."""
    return F.datediff(day, F.lit(SAS_EPOCH).cast("date"))


def index_date(offset_days: Column, base: str = STUDY_BASE_DATE) -> Column:
    return F.date_add(F.lit(base).cast("date"), offset_days)


def day_span(expdate: Column, notedate: Column) -> Column:
    """Signed days from the note to the index date; negative after the index date."""
    return F.datediff(expdate, notedate)


def empi_indexdt(empi: Column, expdate: Column) -> Column:
    """Participant and SAS date, as a string so that long numbers keep their digits."""
    return F.concat(empi.cast("string"), sas_date(expdate).cast("string"))


def split_empi_indexdt(key: Column) -> tuple[Column, Column]:
    """Participant and index date of an ``empi_indexdt`` key.

    The SAS date takes the last five digits, as it does from May 1987 to October 2233.
    """
    days = F.right(key, F.lit(5)).cast("int")
    return F.substring(key, F.lit(1), F.length(key) - 5), F.date_add(F.lit(SAS_EPOCH).cast("date"), days)


def empi_exp_date(empi: Column, expdate: Column) -> Column:
    return F.concat(empi.cast("string"), F.date_format(expdate, "MMddyyyy"))


def outcome_flag(raw: Column) -> Column:
    return F.when(raw == "1", F.lit("1")).otherwise(F.lit("0"))


def positive_to_one(value: Column, other: Column | None = None) -> Column:
    """``> 0`` becomes 1, the rest 0 (or ``other``); null stays null."""
    rest = F.lit(0) if other is None else other
    return F.when(value.isNull(), F.lit(None)).when(value > 0, F.lit(1)).otherwise(rest)


def fill_missing(df: DataFrame, text: str = "NA", number: int | None = None) -> DataFrame:
    """Null strings become ``NA``; null numbers become ``number`` when one is given."""
    out = df.fillna(text)
    return out if number is None else out.fillna(number)


def align_types(df: DataFrame, target: DataFrame) -> DataFrame:
    """Cast the columns shared with ``target`` to its types."""
    types = {f.name: f.dataType for f in target.schema.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def key_first(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])
