"""Day strings: the canonical index form and real dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.blanks import null_if_empty, strip

DOTTED = r"\A[0-9]{2}\.[0-9]{2}\.[0-9]{4}\z"
SLASHED = r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"
DASHED = r"\A[0-9]{2}-[0-9]{2}-[0-9]{4}\z"
ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def day_text(value: Column) -> Column:
    """``dd.MM.yyyy`` for the four accepted spellings, null for anything else.

    A spelling check only: 31.02.2020 passes, as searches must still find it.
    """
    return (
        F.when(value.rlike(DOTTED), value)
        .when(value.rlike(SLASHED), F.translate(value, "/", "."))
        .when(value.rlike(DASHED), F.translate(value, "-", "."))
        .when(
            value.rlike(ISO),
            F.concat_ws(".", F.substring(value, 9, 2), F.substring(value, 6, 2), F.substring(value, 1, 4)),
        )
    )


def day_value(text: Column) -> Column:
    """The calendar day of a canonical day string; null when there is none."""
    return F.try_to_date(text, "dd.MM.yyyy")


def moment(value: Column) -> Column:
    """A timestamp from the spellings found in source descriptions.

    ISO date or date-time, ``dd.MM.yyyy``, or text that starts with
    ``yyyy-MM-dd``. Null when none fits. Epoch numbers go through
    :func:`epoch_moment`, because as text they are not dates.
    """
    text = null_if_empty(strip(value))
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        F.try_to_date(text, "dd.MM.yyyy").cast("timestamp_ntz"),
        F.try_to_date(F.regexp_extract(text, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), "yyyy-MM-dd").cast(
            "timestamp_ntz"
        ),
    )


def epoch_moment(milliseconds: Column) -> Column:
    return F.timestamp_millis(milliseconds).cast("timestamp_ntz")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[null_if_empty(v) for v in values])
