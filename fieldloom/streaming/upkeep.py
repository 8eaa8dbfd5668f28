"""Incremental index upkeep.

The checkpoint is the list of files already indexed. A run takes up the files
that are new, batch by batch; a stopped run goes on where it ended, and each
finished batch can be searched at once. The file source does not notice files
that changed or vanished, so compare manifests first: see ``plan_run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldloom.catalog import Catalog
from fieldloom.operators.manifest import build_mode, manifest_diff
from fieldloom.operators.postings import postings

DOCUMENT_SCHEMA = (
    "doc_id string, source_table string, row_id string, seq bigint, imported_at timestamp, "
    "fields map<string,string>, invalid_fields map<string,string>, raw string"
)


def read_document_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append everything available now and stop."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    if "term" in rows.columns:
        # Arriving batches are not sorted by term; Bloom filters serve exact searches.
        writer = writer.option("parquet.bloom.filter.enabled#term", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_new_files(
    spark: SparkSession, documents_path: str, postings_path: str, checkpoint: str, catalog: Catalog, max_files: int | None = None
) -> StreamingQuery:
    """Index the document files the checkpoint has not seen yet."""
    arriving = read_document_stream(spark, documents_path, max_files)
    return append_stream(postings(arriving, catalog), postings_path, checkpoint, ["field"])


def plan_run(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``full`` (new output and checkpoint), ``incremental`` or ``noop``."""
    return build_mode(manifest_diff(previous, current))
