"""Search: a flat ``{field: value}`` query becomes filters over postings.

All fields are answered in one pass: rows that satisfy some field's predicate
are kept, and a document matches when it satisfied every field. Documents are
grouped by id after a partial aggregation, so a hot term is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog
from fieldloom.functions.fields import (
    has_wildcard,
    like_pattern,
    literal_prefix,
    query_term,
    wildcard_match,
    wildcard_regex,
)
from fieldloom.functions.shards import shard_name


@dataclass(frozen=True)
class Term:
    """One field of a query in comparable form."""

    field: str
    term: str
    wildcard: bool
    prefix: str
    pattern: str
    regex: str
    shard: str


def resolve(spark: SparkSession, query: Mapping[str, str | None], catalog: Catalog, strict: bool = False) -> list[Term]:
    """Bring a query to index form.

    Unknown and empty fields are dropped, and so is a value of which nothing
    remains: the search widens. With ``strict`` such a field or value empties the
    result instead. The values of one query are all the driver ever handles here.
    """
    asked = {name: str(value) for name, value in query.items() if name in catalog and catalog[name].indexed and value}
    if not asked or (strict and len(asked) < len(query)):
        return []
    columns = []
    for name, value in asked.items():
        term = query_term(catalog[name], F.lit(value))
        columns.append(
            F.struct(
                term.alias("term"),
                has_wildcard(term).alias("wildcard"),
                literal_prefix(term).alias("prefix"),
                like_pattern(term).alias("pattern"),
                wildcard_regex(term).alias("regex"),
                shard_name(catalog[name], term).alias("shard"),
            ).alias(name)
        )
    # Expressions over constants: Spark works them out while planning, without a job.
    row = spark.sql("SELECT * FROM VALUES (0)").select(*columns).first()
    terms = [Term(name, **row[name].asDict()) for name in asked if row[name]["term"]]
    if strict and len(terms) < len(asked):
        return []
    return terms


def after_prefix(prefix: str) -> str | None:
    """The smallest text greater than all texts that start with ``prefix``."""
    last = ord(prefix[-1])
    if last >= 0xD7FF:
        return None
    return prefix[:-1] + chr(last + 1)


def term_filter(term: Term) -> Column:
    """The posting predicate of one query field.

    A wildcard gets an explicit range on its literal prefix: Parquet can skip
    row groups by it, which it cannot do for a LIKE with a wildcard inside.
    """
    here = F.col("field") == term.field
    if not term.wildcard:
        return here & (F.col("term") == term.term)
    if term.prefix:
        here = here & (F.col("term") >= term.prefix)
        upper = after_prefix(term.prefix)
        if upper is not None:
            here = here & (F.col("term") < upper)
    return here & wildcard_match(F.col("term"), F.lit(term.pattern), F.lit(term.regex))


def matching_ids(
    postings: DataFrame, terms: list[Term], shard_stats: DataFrame | None = None
) -> DataFrame:
    """Ids of the documents that satisfy every term: ``doc_id, source_table``.

    With shard counts at hand, the narrowest exact term goes first: the other
    terms' postings are cut down to its documents. Spark decides by measured
    sizes how that join is done.
    """
    keys = ["doc_id", "source_table"]
    if not terms:
        return postings.select(*keys).limit(0)
    if len(terms) == 1:
        return postings.where(term_filter(terms[0])).select(*keys).distinct()

    filters = [term_filter(t) for t in terms]
    narrow = _narrowest(terms, shard_stats) if shard_stats is not None else None
    candidates = postings.where(reduce(or_, filters))
    if narrow is not None:
        first = postings.where(filters[narrow]).select("doc_id")
        candidates = candidates.join(first, "doc_id", "left_semi")
    bit = F.lit(0)
    for i, condition in enumerate(filters):
        bit = bit.bitwiseOR(F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)))
    seen = candidates.select(*keys, bit.alias("bit")).groupBy(*keys).agg(F.bit_or("bit").alias("seen"))
    return seen.where(F.col("seen") == (1 << len(terms)) - 1).select(*keys)


def _narrowest(terms: list[Term], shard_stats: DataFrame) -> int | None:
    """The exact term with the smallest shard; shards without a count come last."""
    exact = [(i, t) for i, t in enumerate(terms) if not t.wildcard]
    if len(exact) < 2:
        return exact[0][0] if exact else None
    wanted = reduce(or_, [(F.col("field") == t.field) & (F.col("shard") == t.shard) for _, t in exact])
    counts = {(r["field"], r["shard"]): r["n"] for r in shard_stats.where(wanted).collect()}
    known = [(counts[t.field, t.shard], i) for i, t in exact if (t.field, t.shard) in counts]
    return min(known)[1] if known else None


def search(
    postings: DataFrame,
    query: Mapping[str, str | None],
    catalog: Catalog,
    strict: bool = False,
    shard_stats: DataFrame | None = None,
) -> DataFrame:
    """Ids of the documents a query finds."""
    terms = resolve(postings.sparkSession, query, catalog, strict)
    return matching_ids(postings, terms, shard_stats)
