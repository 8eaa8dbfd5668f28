"""From matching ids to full records, source headers and the result stream."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.catalog import Catalog
from fieldloom.functions.blanks import null_if_empty, strip
from fieldloom.functions.texts import map_text
from fieldloom.operators.positions import block_of, running_totals
from fieldloom.operators.records import merged_fields

DEFAULT_TYPE = "local-import"
CHUNK_ITEMS = 200
KEYS = ["doc_id", "source_table"]
SUGGESTIONS = 24


def fetch(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of the given ids; the first one when an id is stored twice.

    The documents are read once. Only rows found are moved, and copies of one id are
    reduced before that, so a row copied very often stays one row per task.
    """
    return first_of_each(documents.join(ids.select(*KEYS), KEYS, "left_semi"))


def first_of_each(documents: DataFrame) -> DataFrame:
    """The first stored document per id.

    The first has the smallest number, of equal numbers the earliest import; of copies
    that agree in both one stays.
    """
    order = F.struct("seq", *[c for c in ("imported_at",) if c in documents.columns])
    rest = [c for c in documents.columns if c not in KEYS]
    firsts = documents.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return firsts.select(*KEYS, "_first.*").select(*documents.columns)


def result_records(documents: DataFrame) -> DataFrame:
    """What a search shows of a document."""
    return documents.select(
        "doc_id",
        "source_table",
        "seq",
        merged_fields(F.col("fields"), F.col("invalid_fields")).alias("fields"),
    )


def header_columns() -> list[Column]:
    """Header texts of a source row that may be missing."""
    name = null_if_empty(F.col("name"))
    origin = F.concat(F.lit("Import from file "), null_if_empty(F.col("file_name")))
    kind = F.coalesce(null_if_empty(F.col("type")), F.lit(DEFAULT_TYPE))
    return [
        F.coalesce(name, F.col("source_table")).alias("name"),
        F.coalesce(null_if_empty(F.col("description")), origin, F.lit("Local source")).alias("info"),
        kind.alias("type"),
    ]


def result_headers(records: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One header per source met in the results, with its record count; with ``by`` per query."""
    met = records.groupBy(*by, "source_table").agg(F.count("*").alias("records"))
    joined = met.join(sources.drop("records"), "source_table", "left")
    return joined.select(*by, "source_table", *header_columns(), "records")


def batch_records(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Records of many queries' hits: ``query_id`` and the columns of ``result_records``.

    A document is fetched once, however many queries found it.
    """
    found = result_records(fetch(documents, hits.select(*KEYS).distinct()))
    return hits.select("query_id", *KEYS).join(found, KEYS).select("query_id", *found.columns)


def result_stream(records: DataFrame, sources: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """Headers and records as one numbered stream, cut into chunks.

    Order is by source and record number, each header right before the first
    record of its source. Positions come from totals per block and per source,
    so no task sees the whole stream.
    """
    headers = result_headers(records, sources)
    before = Window.orderBy("source_table").rowsBetween(Window.unboundedPreceding, -1)
    starts = headers.select(
        "*", F.coalesce(F.sum(F.col("records") + 1).over(before), F.lit(0)).cast("bigint").alias("start")
    )
    numbered = running_totals(
        records,
        by=["source_table"],
        order=["seq", "doc_id"],
        totals={"earlier": F.lit(1)},
        block=block_of(F.col("seq")),
    )
    items = numbered.join(starts.select("source_table", "start"), "source_table").select(
        (F.col("start") + F.col("earlier") + 1).alias("position"),
        F.lit("record").alias("kind"),
        "source_table",
        "doc_id",
        map_text(F.col("fields")).alias("body"),
    )
    heads = starts.select(
        F.col("start").alias("position"),
        F.lit("header").alias("kind"),
        "source_table",
        F.lit(None).cast("string").alias("doc_id"),
        F.concat_ws(" | ", "name", "info", "type").alias("body"),
    )
    return heads.unionByName(items).withColumn("chunk", F.floor(F.col("position") / chunk_items).cast("bigint"))


def chunk_after(stored: DataFrame, position: int = -1, items: int = CHUNK_ITEMS) -> DataFrame:
    """The next items of a stored stream behind a position: any chunk, without the ones before.

    Positions have no gaps, so a chunk is a range of them, which the scan skips to.
    """
    wanted = (F.col("position") > position) & (F.col("position") <= position + items)
    return stored.where(wanted).orderBy("position")


def iterate_chunks(stream: DataFrame) -> Iterator[list[Row]]:
    """Deliver the stream in order, one chunk in memory at a time."""
    chunk: list[Row] = []
    for row in stream.orderBy("position").toLocalIterator(prefetchPartitions=True):
        if chunk and chunk[0]["chunk"] != row["chunk"]:
            yield chunk
            chunk = []
        chunk.append(row)
    if chunk:
        yield chunk


def split_kinds(stream: DataFrame) -> dict[str, DataFrame]:
    """The stream's variants as separate tables."""
    known = ("header", "record", "group", "suggestion")
    tables = {kind: stream.where(F.col("kind") == kind) for kind in known}
    tables["unknown"] = stream.where(F.col("kind").isNull() | ~F.col("kind").isin(*known))
    return tables


def result_totals(records: DataFrame) -> DataFrame:
    """Counts shown after a search. Headers count as results."""
    per_source = records.groupBy("source_table").agg(F.count("*").alias("n"))
    return per_source.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).alias("total_results"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("matched_documents"),
        F.count("*").alias("matched_sources"),
    )


def suggestions(
    records: DataFrame, query: Mapping[str, str | None], catalog: Catalog, limit: int | None = SUGGESTIONS
) -> DataFrame:
    """Field values of the results that could be searched next.

    Distinct in order of first appearance, without the query's own values. The
    limit is part of the feature: a short list of proposals.
    """
    shown = [spec.name for spec in catalog.indexed]
    cells = records.select("source_table", "seq", F.posexplode_outer("fields").alias("pos", "field", "value"))
    cells = cells.withColumn("value", strip(F.col("value")))
    cells = cells.where(F.col("field").isin(*shown) & (F.col("value") != ""))
    for name, value in query.items():
        if value is not None and str(value).strip():
            cells = cells.where(~((F.col("field") == name) & (F.col("value") == str(value).strip())))
    place = F.struct("source_table", "seq", "pos")
    firsts = cells.groupBy("field", "value").agg(F.min(place).alias("_place"))
    if limit is not None:
        firsts = firsts.orderBy("_place", "field", "value").limit(limit)
    return firsts.select("field", "value")


def facet_counts(records: DataFrame) -> DataFrame:
    """How often each value of each field occurs. One row per value: a field
    with many distinct values stays spread out."""
    cells = records.select(F.explode_outer("fields").alias("key", "value")).where(F.col("key").isNotNull())
    return cells.groupBy("key", "value").agg(F.count("*").alias("n"))


def with_labels(rows: DataFrame, key: str, labels: DataFrame, out: str = "label") -> DataFrame:
    """Add the display label of a key; the key itself when it has none.

    ``labels`` has ``key, label``. Keys repeat heavily, so each distinct key is
    labelled once and the counts of work stay at the size of the dictionary.
    """
    named = labels.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
    joined = rows.join(named, F.col(key) == F.col("_key"), "left")
    return joined.select(*rows.columns, F.coalesce("_label", F.col(key)).alias(out))
