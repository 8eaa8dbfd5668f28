"""What a field kind means, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.catalog import DIGIT_KINDS, Catalog, FieldSpec
from fieldloom.functions.blanks import BLANK_CLASS, digits_only, drop_blanks, null_if_empty, squeeze, strip
from fieldloom.functions.dates import day_text

# Patterns a clean value has to meet.
EMAIL = r"\A[^ @]+@[^ @]+\.[^ @]+\z"
WORD_LETTERS = r"\A[a-zA-Zа-яА-ЯёЁіІїЇєЄґҐ-]+\z"
WILDCARDS = "[?%]"


def clean_value(spec: FieldSpec, stripped: Column, digits: Column | None = None) -> Column:
    """The stored form of a valid value, null for an invalid one.

    ``stripped`` is the value without outer blanks. Callers that hold its digits
    pass them, so that they are not computed again per use.
    """
    if spec.kind == "digits":
        digits = digits_only(stripped) if digits is None else digits
        return F.when(F.length(digits).between(spec.low, spec.high), digits)
    if spec.kind == "digits_exact":
        lengths = "|".join(f"[0-9]{{{n}}}" for n in spec.lengths)
        return F.when(stripped.rlike(rf"\A(?:{lengths})\z"), stripped)
    if spec.kind == "digits_any":
        return F.when(stripped.rlike(r"\A[0-9]+\z"), stripped)
    if spec.kind == "email":
        return F.when(stripped.rlike(EMAIL), F.lower(stripped))
    if spec.kind == "words":
        several = stripped.rlike(BLANK_CLASS)
        return F.when(several & drop_blanks(stripped).rlike(WORD_LETTERS), F.upper(stripped))
    if spec.kind == "date":
        return day_text(stripped)
    return null_if_empty(stripped)


def index_term(spec: FieldSpec, stripped: Column) -> Column:
    """The term a stored value is found under. May be empty: see callers."""
    if spec.kind in DIGIT_KINDS:
        return digits_only(stripped)
    return _typed_term(spec, stripped)


def query_term(spec: FieldSpec, value: Column) -> Column:
    """The comparable form of a query value; null when nothing is left.

    Wildcards survive. A name without wildcards becomes the pattern "these word
    beginnings, in this order".
    """
    stripped = strip(value)
    if spec.kind in DIGIT_KINDS:
        return null_if_empty(F.regexp_replace(stripped, "[^0-9?%]+", ""))
    term = null_if_empty(_typed_term(spec, stripped))
    if spec.kind == "words":
        phrase = F.concat(F.translate(term, " ", "%"), F.lit("%"))
        return F.when(has_wildcard(term), term).otherwise(phrase)
    return term


def _typed_term(spec: FieldSpec, stripped: Column) -> Column:
    if spec.kind == "email":
        return F.lower(stripped)
    if spec.kind == "words":
        return squeeze(F.upper(stripped))
    if spec.kind == "code":
        return drop_blanks(F.upper(stripped))
    if spec.kind == "date":
        return F.coalesce(day_text(stripped), stripped)
    return stripped


def mined_digit_runs(spec: FieldSpec, value: Column) -> Column:
    """Distinct digit runs of an accepted length, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"([0-9]{{{spec.low},{spec.high}}})"), F.lit(1)))


def has_wildcard(term: Column) -> Column:
    return term.contains("?") | term.contains("%")


def literal_prefix(term: Column) -> Column:
    """The text before the first wildcard, possibly empty."""
    return F.regexp_extract(term, r"\A[^?%]+", 0)


def like_pattern(term: Column) -> Column:
    """A LIKE pattern: ``%`` any run, ``?`` one character, the rest literal."""
    escaped = F.regexp_replace(term, r"([\\_])", r"\\$1")
    return F.translate(escaped, "?", "_")


def wildcard_match(term: Column, pattern: Column, regex: Column) -> Column:
    """Anchored wildcard test. A wildcard never crosses a line break.

    LIKE lets ``%`` run over line breaks, so terms that hold one are tested with
    the regular expression instead; nearly all terms take the cheap branch.
    """
    one_line = ~term.rlike("[\\n\\r\\u2028\\u2029]")
    return F.like(term, pattern) & (one_line | F.rlike(term, regex))


def wildcard_regex(term: Column) -> Column:
    """The same pattern as an anchored regular expression."""
    escaped = F.regexp_replace(term, r"([.*+^${}()|\[\]\\])", r"\\$1")
    body = F.replace(F.replace(escaped, F.lit("%"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit(r"\A(?:"), body, F.lit(r")\z"))


def by_field(catalog: Catalog, name: Column, make) -> Column:
    """``make(spec)`` for the spec whose name a row carries, else null."""
    chosen = None
    for spec in catalog:
        hit = name == spec.name
        chosen = F.when(hit, make(spec)) if chosen is None else chosen.when(hit, make(spec))
    return chosen if chosen is not None else F.lit(None)


def by_kind(specs: Iterable[FieldSpec], name: Column, make, otherwise: Column | None = None) -> Column:
    """As :func:`by_field`, for what depends on a field's kind and lengths: made once for all fields alike.

    ``make(spec)`` may be None for kinds without a value.
    """
    alike: dict[tuple, list[FieldSpec]] = {}
    for spec in specs:
        alike.setdefault((spec.kind, spec.low, spec.high, spec.lengths), []).append(spec)
    chosen = F.when(F.lit(False), F.lit(None))
    for members in alike.values():
        made = make(members[0])
        if made is not None:
            chosen = chosen.when(name.isin(*[s.name for s in members]), made)
    return chosen if otherwise is None else chosen.otherwise(otherwise)
