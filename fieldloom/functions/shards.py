"""Shard names: a readable term prefix, optionally split further by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog, FieldSpec
from fieldloom.functions.blanks import digits_only, strip


def shard_term(spec: FieldSpec, term: Column) -> Column:
    if spec.kind == "digits":
        return digits_only(term)
    return F.regexp_replace(F.lower(strip(term)), "[^a-zа-яё0-9]+", "")


def shard_name(spec: FieldSpec, term: Column) -> Column:
    """Prefix padded with ``_``; hashed fields add ``~`` and hex digits."""
    return _name(spec.shard_prefix, spec.shard_hash, F.lit(spec.name), shard_term(spec, term))


def with_shards(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``shard`` to rows of ``field, term``.

    The normalised term is a column of its own: it is used three times in a name
    and would be computed as often.
    """
    field, term = F.col("field"), F.col("term")
    numeric = [s.name for s in catalog if s.kind == "digits"]
    body = F.regexp_replace(F.lower(strip(term)), "[^a-zа-яё0-9]+", "")
    body = F.when(field.isin(*numeric), digits_only(term)).otherwise(body) if numeric else body
    named = None
    for prefix, hashed in sorted({(s.shard_prefix, s.shard_hash) for s in catalog}):
        members = [s.name for s in catalog if (s.shard_prefix, s.shard_hash) == (prefix, hashed)]
        name = _name(prefix, hashed, field, F.col("_body"))
        named = F.when(field.isin(*members), name) if named is None else named.when(field.isin(*members), name)
    return rows.withColumn("_body", body).withColumn("shard", named).drop("_body")


def _name(prefix: int, hashed: int, field: Column, body: Column) -> Column:
    head = F.rpad(F.substring(body, 1, prefix), prefix, "_")
    if hashed == 0:
        return head
    digest = F.substring(F.md5(F.concat(field, F.lit(":"), body)), 1, hashed)
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("~"), digest))


def document_shard(doc_id: Column) -> Column:
    key = strip(doc_id)
    return F.when(key == "", F.lit("___")).otherwise(F.substring(F.md5(key), 1, 3))
