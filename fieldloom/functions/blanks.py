"""Blank handling. Spark's ``trim`` strips U+0020 only, so the class is explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the source data treats as blank (tab to carriage
# return, space, no-break space, the Unicode space separators, line and
# paragraph separator, byte order mark).
BLANK_CODES = (
    *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
BLANKS = "".join(map(chr, BLANK_CODES))
BLANK_CLASS = f"[{BLANKS}]"


def strip(value: Column) -> Column:
    """Remove blanks at both ends."""
    return F.btrim(value, F.lit(BLANKS))


def squeeze(value: Column) -> Column:
    """Replace every run of blanks by one space and strip the ends."""
    return strip(F.regexp_replace(value, f"{BLANK_CLASS}+", " "))


def drop_blanks(value: Column) -> Column:
    return F.regexp_replace(value, f"{BLANK_CLASS}+", "")


def null_if_empty(value: Column) -> Column:
    return F.when(value != "", value)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")
