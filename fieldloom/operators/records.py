"""Raw records to normalised documents.

Input rows: ``source_table, seq, raw MAP<STRING,STRING>``. Output rows are the
documents: ``doc_id, source_table, row_id, seq, imported_at, fields,
invalid_fields, raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog, NameParts
from fieldloom.functions.blanks import digits_only, null_if_empty, strip
from fieldloom.functions.fields import by_kind, clean_value

INVALID_PREFIX = "no_valid_"
MAP = "map<string,string>"


def composed_name(raw: Column, names: NameParts) -> Column:
    """The filled parts joined by a space; null when all are empty."""
    return null_if_empty(F.concat_ws(" ", *[null_if_empty(strip(raw[p])) for p in names.parts]))


def shape_names(raw: Column, names: NameParts | None) -> Column:
    """Replace name parts by the composed name, unless the record brings one."""
    if names is None:
        return raw
    rest = F.map_filter(raw, lambda k, _: ~k.isin(*names.parts))
    name = composed_name(raw, names)
    absent = ~F.map_contains_key(raw, names.target) & name.isNotNull()
    return F.when(absent, F.map_concat(rest, F.create_map(F.lit(names.target), name))).otherwise(rest)


def row_id(raw: Column, seq: Column) -> Column:
    """The record's own id, or its number. An id of 0 or "" counts as given."""
    return F.coalesce(raw["id"], seq.cast("string"))


def document_id(source_table: Column, row: Column) -> Column:
    return F.concat(source_table, F.lit(":"), row)


def route(raw: Column, catalog: Catalog) -> tuple[Column, list[str]]:
    """Entries ``key, given, value`` of a shaped record, and the checked keys.

    ``value`` is the clean value of a catalogue field, null when it is invalid;
    other keys pass through stripped. Entry order is kept, because exports list
    columns by it.
    """
    known = [spec.name for spec in catalog]
    numeric = [spec.name for spec in catalog if spec.kind == "digits"]

    # One stage per step: a value used by a later step is computed once.
    def stripped(entry: Column) -> Column:
        return F.struct(entry["key"].alias("key"), strip(entry["value"]).alias("given"))

    def with_digits(entry: Column) -> Column:
        digits = F.when(entry["key"].isin(*numeric), digits_only(entry["given"])) if numeric else F.lit("")
        return F.struct(entry["key"].alias("key"), entry["given"].alias("given"), digits.alias("digits"))

    def checked(entry: Column) -> Column:
        clean = by_kind(catalog, entry["key"], lambda s: clean_value(s, entry["given"], entry["digits"]))
        value = F.when(~entry["key"].isin(*known), entry["given"]).otherwise(clean)
        return F.struct(entry["key"].alias("key"), entry["given"].alias("given"), value.alias("value"))

    filled = F.filter(F.map_entries(raw), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    routed = F.transform(F.transform(F.transform(filled, stripped), with_digits), checked)
    return routed, known


def route_sides(routed: Column, known: list[str]) -> tuple[Column, Column]:
    """The valid and the invalid side of routed entries, as maps."""
    fields = F.transform(
        F.filter(routed, lambda e: e["value"].isNotNull()),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    invalid = F.transform(
        F.filter(routed, lambda e: e["value"].isNull() & e["key"].isin(*known) & (e["given"] != "")),
        lambda e: F.struct(F.concat(F.lit(INVALID_PREFIX), e["key"]).alias("key"), e["given"].alias("value")),
    )
    return F.map_from_entries(fields), F.map_from_entries(invalid)


def records_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The raw records of the given ids (``doc_id, source_table``), which may repeat.

    Documents made of these alone are those of all records with these ids, but no record
    that nobody asked for is checked and unfolded. Sources without an id are left out
    before records are moved.
    """
    keys = ["doc_id", "source_table"]
    met = F.broadcast(ids.select("source_table").distinct())
    row = row_id(F.col("raw"), F.col("seq"))
    keyed = records.join(met, "source_table", "left_semi").withColumn("doc_id", document_id(F.col("source_table"), row))
    return keyed.join(ids.select(*keys), keys, "left_semi").select(*records.columns)


def documents(records: DataFrame, catalog: Catalog, imported_at: Column | None = None) -> DataFrame:
    """One document per raw record. A projection: no shuffle."""
    shaped = records.withColumn("_shaped", shape_names(F.col("raw"), catalog.names))
    routed, known = route(F.col("_shaped"), catalog)
    shaped = shaped.withColumn("_routed", routed)
    fields, invalid = route_sides(F.col("_routed"), known)
    row = row_id(F.col("raw"), F.col("seq"))
    stamp = imported_at if imported_at is not None else F.current_timestamp()
    return shaped.select(
        document_id(F.col("source_table"), row).alias("doc_id"),
        "source_table",
        row.alias("row_id"),
        "seq",
        stamp.alias("imported_at"),
        fields.alias("fields"),
        invalid.alias("invalid_fields"),
        F.to_json("raw").alias("raw"),
    )


def merged_fields(fields: Column, invalid: Column) -> Column:
    """Both sides as one map; an invalid entry replaces a field of its name."""
    others = F.map_filter(fields, lambda k, _: ~F.map_contains_key(invalid, k))
    return F.map_concat(others, invalid)
