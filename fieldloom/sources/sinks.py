"""Writers. Spark's commit protocol makes each write all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 2_000_000
ROW_GROUP_BYTES = 4 << 20
#: Documents are read by row groups; one of Parquet's usual size would be work for minutes in one task.
DOCUMENT_GROUP_BYTES = 16 << 20


def write_documents(documents: DataFrame, path: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Documents by source, with a Bloom filter on the id for point lookups."""
    (
        documents.write.mode(mode)
        .partitionBy("source_table")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#doc_id", "true")
        .option("parquet.block.size", DOCUMENT_GROUP_BYTES)
        .parquet(path)
    )


def replace_sources(documents: DataFrame, path: str) -> None:
    """Documents by source; a source that is already there is replaced, others stay."""
    (
        documents.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_table")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("parquet.bloom.filter.enabled#doc_id", "true")
        .option("parquet.block.size", DOCUMENT_GROUP_BYTES)
        .parquet(path)
    )


def write_postings(postings: DataFrame, path: str, mode: str = "append") -> None:
    """Postings by field, gathered by shard and sorted by term.

    A rebalance brings the rows of a shard together, merges small partitions and
    splits those that a hot shard or term made too large, at no extra pass over
    the data (a range partitioning would run the whole plan once to sample it).
    Sorting makes the row-group minima serve exact and prefix searches.
    """
    gathered = postings.hint("rebalance", "field", "shard").sortWithinPartitions("field", "term", "doc_id")
    gathered.write.mode(mode).partitionBy("field").parquet(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export lines as text: one folder per source, in (part, seq) order.

    Ranges over (source, part, seq) let a large source fill many files, which
    in name order form the whole text.
    """
    ordered = lines.repartitionByRange("source_table", "part", "seq").sortWithinPartitions("source_table", "part", "seq")
    ordered.select("source_table", F.col("line").alias("value")).write.mode(mode).partitionBy("source_table").text(path)


def write_document(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An export file's lines ``place, part, seq, line`` as text files that in name order form the whole."""
    order = ("place", "part", "seq")
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_stream_rows(stream: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A numbered result stream in order of position, with small row groups.

    Their least and greatest positions let a reader open a chunk without those before it.
    """
    ordered = stream.repartitionByRange("position").sortWithinPartitions("position")
    ordered.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def write_segments(planned: DataFrame, path: str, line: str = "line", mode: str = "append") -> None:
    """Lines with ``file_name, seq, segment`` into one folder per segment."""
    placed = planned.repartition("file_name", "segment").sortWithinPartitions("file_name", "segment", "seq")
    placed.select("file_name", "segment", F.col(line).alias("value")).write.mode(mode).partitionBy(
        "file_name", "segment"
    ).text(path)
