"""Index statistics: shard counts, summaries and skew reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.shards import document_shard
from fieldloom.functions.texts import byte_size
from fieldloom.operators.positions import running_totals
from fieldloom.session import written

TOP_SHARDS = 20


def shard_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "shard").agg(F.count("*").alias("n"))


def entry_bytes() -> Column:
    """Size of a posting as a line of text: the weight used in skew reports."""
    parts = [F.octet_length(F.col(c)) for c in ("term", "doc_id", "source_table", "row_id")]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("bigint")


def shard_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "shard").agg(F.sum(entry_bytes()).alias("bytes"))


def shards_with_sizes(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts and sizes of all shards named by either side."""
    return stats.join(sizes, ["field", "shard"], "full_outer").select(
        "field",
        "shard",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )


def shard_profile(shards: DataFrame) -> DataFrame:
    """Per field: shard count, totals, rounded mean and the largest shard."""
    size = F.struct(F.col("n"), F.col("bytes"), F.col("shard"))
    return (
        shards.groupBy("field")
        .agg(
            F.count("*").alias("shards"),
            F.sum("n").alias("entries"),
            F.sum("bytes").alias("bytes"),
            F.max(size).alias("_largest"),
        )
        .select(
            "field",
            "shards",
            "entries",
            F.floor(F.col("entries") / F.col("shards") + 0.5).cast("bigint").alias("mean_entries"),
            byte_size(F.col("bytes")).alias("size"),
            F.col("_largest.shard").alias("largest_shard"),
            F.col("_largest.n").alias("largest_entries"),
            F.col("_largest.bytes").alias("largest_bytes"),
        )
    )


def hot_shards(shards: DataFrame, top: int = TOP_SHARDS) -> DataFrame:
    """The fullest shards: a top-k, never a full sort."""
    return shards.orderBy(F.desc("n"), F.desc("bytes"), "field", "shard").limit(top)


def document_shards(documents: DataFrame) -> DataFrame:
    return documents.groupBy(document_shard(F.col("doc_id")).alias("shard")).agg(F.count("*").alias("n"))


def index_summary(postings: DataFrame) -> DataFrame:
    """Entries and documents per source and field, per source, and in all.

    Rows with a null field or source are the totals. The postings are read once:
    they are reduced to a count per document and field, and within each document
    its first field also stands for the document. Totals are sums of those, so no
    total gathers ids.
    """
    per_field = postings.groupBy("source_table", "doc_id", "field").agg(F.count("*").alias("n"))
    counts = F.array_agg(F.struct("field", "n"))
    per_document = per_field.groupBy("source_table", "doc_id").agg(counts.alias("fields"))
    rows = per_document.select("source_table", F.posexplode("fields").alias("place", "cell")).select(
        "source_table",
        F.col("cell.field").alias("field"),
        F.col("cell.n").alias("n"),
        F.when(F.col("place") == 0, 1).otherwise(0).alias("head"),
    )
    cells = rows.groupBy("source_table", "field").agg(
        F.sum("n").alias("entries"), F.count("*").alias("documents"), F.sum("head").alias("heads")
    )
    totals = cells.rollup("source_table", "field").agg(
        F.sum("entries").alias("entries"),
        F.when(F.grouping_id() == 0, F.sum("documents")).otherwise(F.sum("heads")).alias("documents"),
    )
    return totals.select("source_table", "field", "entries", "documents")


def duplicate_ids(documents: DataFrame) -> DataFrame:
    """Ids stored more than once: all but the first record are unreachable."""
    counted = documents.groupBy("doc_id").agg(F.count("*").alias("copies"))
    return counted.where("copies > 1")


def sample_stats(samples: DataFrame, by: str, value: str, blocks: int = 64) -> DataFrame:
    """Count, minimum, maximum, mean and exact median of ``value`` per group.

    Null values are no samples; a group without any has no row. Samples are
    combined per distinct value; the median is the mean of the values at the two
    middle ranks, found by running totals over blocks between approximate
    quantiles of the distinct values, so an outlier does not empty the blocks.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts, "sample-counts")
    totals = counts.groupBy(by).agg(
        F.sum("n").alias("samples"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile_approx("v", [i / blocks for i in range(1, blocks)]).alias("cuts"),
    )
    same = F.col(by).eqNullSafe(F.col("_by"))
    placed = written(counts.join(totals.withColumnRenamed(by, "_by"), same).drop("_by"), "sample-values")
    block = F.size(F.filter("cuts", lambda cut: cut < F.col("v")))
    ranked = running_totals(placed, by=[by], order=["v"], totals={"below": F.col("n")}, block=block)
    low, high = F.expr("(samples - 1) div 2"), F.expr("samples div 2")
    middle = ranked.where((F.col("below") <= high) & (F.col("below") + F.col("n") > low))
    return middle.groupBy(by, "samples", "min", "max", "mean").agg(((F.min("v") + F.max("v")) / 2).alias("median"))
