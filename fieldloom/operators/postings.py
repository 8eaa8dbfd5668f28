"""The inverted index: one row per document, field and term.

Terms are laid out as one array per row and unfolded once. Everything is a
built-in expression with generated code: no lambdas, no shuffle, no Python.
Values used more than once (a stripped value, its digits) are columns of their
own stage, because inside CASE branches Spark would compute them per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog, FieldSpec
from fieldloom.functions.blanks import digits_only, strip
from fieldloom.functions.fields import by_kind, index_term, mined_digit_runs
from fieldloom.functions.shards import with_shards
from fieldloom.operators.records import INVALID_PREFIX, composed_name, document_id, row_id

COLUMNS = ("field", "shard", "term", "doc_id", "source_table", "row_id")
ENTRIES = "array<struct<field:string,term:string>>"


def postings(documents: DataFrame, catalog: Catalog, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of stored documents, with the document's columns in ``keep``.

    A field is found under the term of its valid value and under the fallback
    terms of its invalid one, each term once per document.

    The maps are unfolded before terms are made, so the work goes by the fields that a
    document holds, not by those of the catalogue, and the generated code stays small
    enough for the JVM to compile it.
    """
    ids = ["doc_id", "source_table", "row_id", *keep]
    empty = F.array().cast("array<struct<key:string,value:string>>")
    sides = [F.coalesce(F.map_entries(side), empty) for side in ("fields", "invalid_fields")]
    given = documents.select(*ids, "fields", F.posexplode_outer(F.concat(*sides)).alias("_place", "_entry"))
    valid = F.col("_place") < F.coalesce(F.size("fields"), F.lit(0))
    key = F.col("_entry.key")
    fallback = F.when(F.startswith(key, F.lit(INVALID_PREFIX)), F.substring(key, len(INVALID_PREFIX) + 1, 1 << 30))
    named = given.select(
        *ids, "fields", valid.alias("_valid"), F.when(valid, key).otherwise(fallback).alias("field"), F.col("_entry.value").alias("_value")
    )
    named = named.where(F.col("field").isin(*[s.name for s in catalog.indexed]))
    own = F.when(~F.col("_valid"), F.col("fields")[F.col("field")])
    stripped = named.select(*ids, "_valid", "field", strip(F.col("_value")).alias("_value"), strip(own).alias("_own"))
    mined = by_kind(catalog.indexed, F.col("field"), lambda s: mined_digit_runs(s, F.col("_value")) if s.kind == "digits" else None)
    term = by_kind(catalog.indexed, F.col("field"), lambda s: index_term(s, F.col("_value")))
    listed = stripped.select(
        *ids, "field", "_own", F.coalesce(F.when(~F.col("_valid"), mined), F.array(term)).alias("_terms")
    )
    # An invalid value beside a valid one does not repeat its term.
    first = by_kind(catalog.indexed, F.col("field"), lambda s: index_term(s, F.col("_own")))
    fresh = F.col("_own").isNull() | (F.col("term") != first)
    unfolded = listed.select(*ids, "field", "_own", F.explode_outer("_terms").alias("term")).where((F.col("term") != "") & fresh)
    return with_shards(unfolded, catalog).select(*COLUMNS, *keep)


def record_postings(records: DataFrame, catalog: Catalog) -> DataFrame:
    """The same postings straight from raw records.

    Skips the document maps, so over tables Catalyst reads only the columns
    behind the catalogue's fields. A value is either valid or not, and except
    for mined digit runs its term is the same in both cases.
    """
    raw, names = F.col("raw"), catalog.names
    value, digits, runs = "_value_{}".format, "_digits_{}".format, "_runs_{}".format

    def given(spec: FieldSpec) -> Column:
        if names is not None and spec.name == names.target:
            return F.when(F.map_contains_key(raw, spec.name), raw[spec.name]).otherwise(composed_name(raw, names))
        if names is not None and spec.name in names.parts:
            return F.lit(None).cast("string")
        return raw[spec.name]

    row = row_id(raw, F.col("seq"))
    rows = records.select(
        document_id(F.col("source_table"), row).alias("doc_id"),
        "source_table",
        row.alias("row_id"),
        *[strip(given(s)).alias(value(s.name)) for s in catalog.indexed],
    )
    mining = [s for s in catalog.indexed if s.kind == "digits"]
    rows = rows.select("*", *[digits_only(F.col(value(s.name))).alias(digits(s.name)) for s in mining])
    fits = {s.name: F.length(digits(s.name)).between(s.low, s.high) for s in mining}
    rows = rows.select(
        "*", *[F.when(~fits[s.name], mined_digit_runs(s, F.col(value(s.name)))).alias(runs(s.name)) for s in mining]
    )
    entries = []
    for spec in catalog.indexed:
        if spec.kind == "digits":
            entries.append(_single(spec, F.when(fits[spec.name], F.col(digits(spec.name)))))
            entries.append(_several(spec, F.col(runs(spec.name))))
        else:
            entries.append(_single(spec, index_term(spec, F.col(value(spec.name)))))
    return _unfold(rows, entries, catalog)


def _single(spec: FieldSpec, term: Column) -> Column:
    return F.array(F.struct(F.lit(spec.name).alias("field"), term.alias("term")))


def _several(spec: FieldSpec, terms: Column) -> Column:
    found = F.coalesce(terms, F.array().cast("array<string>"))
    return F.arrays_zip(F.array_repeat(F.lit(spec.name), F.size(found)), found).cast(ENTRIES)


def _unfold(rows: DataFrame, entries: list[Column], catalog: Catalog) -> DataFrame:
    ids = ["doc_id", "source_table", "row_id"]
    listed = rows.select(*ids, F.concat(*entries).alias("_entries"))
    # The outer form: for the plain one Spark adds a "not empty" filter below,
    # which would compute the whole array a second time.
    unfolded = listed.select(*ids, F.inline_outer("_entries")).where(F.col("term") != "")
    return with_shards(unfolded, catalog).select(*COLUMNS)
