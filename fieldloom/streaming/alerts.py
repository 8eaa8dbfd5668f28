"""Standing queries: arriving postings against a table of query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog
from fieldloom.operators.batch import exact_hits, matched_terms, query_terms


def standing_hits(arriving: DataFrame, queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Hits of exact standing queries, as a stream–static join.

    No state is kept: each posting meets the whole query table in its batch. The
    postings of one term are salted, as a batch has no adaptive skew handling.
    """
    return exact_hits(arriving, query_terms(queries, catalog))


def standing_wildcard_hits(arriving: DataFrame, queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Hits of standing wildcard queries, one row per matching term.

    Patterns meet postings by a piece of text that every match holds, as in a batch
    search. A document whose terms match twice is reported with both terms, so no
    state is needed to tell repeats apart.
    """
    patterns = query_terms(queries, catalog).where("wildcard")
    hits = matched_terms(patterns, arriving, keep=("doc_id", "source_table"))
    return hits.select("query_id", "doc_id", "source_table", "field", "term")
