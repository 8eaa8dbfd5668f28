"""Cleaning and checking of values a person typed into a search form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.catalog import DIGIT_KINDS, FieldSpec
from fieldloom.functions.fields import has_wildcard

# Characters a typed value may keep, per kind. Wildcards stay.
KEPT = {
    "digits": "[^0-9?%]+",
    "digits_exact": "[^0-9?%]+",
    "digits_any": "[^0-9?%]+",
    "code": "[^a-zA-Z0-9?%]+",
    "words": "[^a-zA-Zа-яА-ЯёЁ ?%]+",
    "text": "[^a-zA-Zа-яА-Я0-9?%]+",
}
# Longest typed value, per kind.
LONGEST = {"digits": 15, "words": 255, "email": 255, "code": 17, "date": 10}


def sanitize(spec: FieldSpec, value: Column) -> Column:
    """Keep the allowed characters of a typed value and cut it to its length."""
    if spec.kind == "date":
        return _typed_date(value)
    if spec.kind == "email":
        return _typed_email(value, spec.max_length or LONGEST["email"])
    kept = F.regexp_replace(value, KEPT[spec.kind], "")
    longest = spec.max_length or LONGEST.get(spec.kind)
    if spec.kind == "digits_exact":
        longest = spec.max_length or max(spec.lengths)
    return kept if longest is None else F.substring(kept, 1, longest)


def _typed_date(value: Column) -> Column:
    """Digits with dots put in after the day and the month."""
    text = F.substring(F.regexp_replace(value, "[^0-9.?%]+", ""), 1, LONGEST["date"])
    for place in (2, 5):
        dotted = F.concat(F.substring(text, 1, place), F.lit("."), F.substring(text, place + 1, LONGEST["date"]))
        needs = (F.length(text) > place) & (F.substring(text, place + 1, 1) != ".")
        text = F.when(needs, dotted).otherwise(text)
    return text


def _typed_email(value: Column, longest: int) -> Column:
    """At most one ``@``; a star is only kept as the end of the domain."""
    text = F.substring(value, 1, longest)
    before, after = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    signs = F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit("")))
    domain = F.when(after.contains("*"), F.concat(F.substring_index(after, "*", 1), F.lit("*"))).otherwise(after)
    single = F.when(before.contains("*"), F.replace(before, F.lit("*"), F.lit(""))).otherwise(
        F.concat(before, F.lit("@"), domain)
    )
    return (
        F.when(signs == 0, F.replace(text, F.lit("*"), F.lit("")))
        .when(signs == 1, single)
        .otherwise(F.substring_index(text, "@", 2))
    )


def is_acceptable(spec: FieldSpec, value: Column) -> Column:
    """Pattern test of a typed value; wildcard values always pass."""
    if not spec.pattern:
        return F.lit(True)
    return has_wildcard(value) | value.rlike(spec.pattern)


__all__ = ["DIGIT_KINDS", "is_acceptable", "sanitize"]
