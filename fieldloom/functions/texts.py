"""Small text formats used by reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """A CSV cell: quoted only when it holds a quote, a comma or a line feed."""
    text = F.coalesce(value, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def leading_int(value: Column) -> Column:
    """The integer a text starts with, 0 when there is none."""
    digits = F.regexp_extract(value, r"\A\s*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def grouped_count(value: Column) -> Column:
    """A count with digit groups, for catalogue rows."""
    return F.format_number(F.coalesce(value, F.lit(0)), 0)


def byte_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    kib, mib, gib = 1024, 1024**2, 1024**3

    def scaled(unit: int, name: str) -> Column:
        return F.concat(F.format_string("%.2f", size.cast("double") / F.lit(float(unit))), F.lit(f" {name}"))

    return (
        F.when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, scaled(kib, "KB"))
        .when(size < gib, scaled(mib, "MB"))
        .otherwise(scaled(gib, "GB"))
    )


def sheet_base_name(name: Column) -> Column:
    """A worksheet name: forbidden characters replaced, at most 31 long."""
    return F.substring(F.regexp_replace(name, r"[/\\?*\[\]:]", "_"), 1, 31)


def map_text(entries: Column) -> Column:
    """A map as ``key=value`` pairs joined by ``;``, in entry order."""
    return F.array_join(
        F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))),
        ";",
    )
