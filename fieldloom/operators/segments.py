"""Byte offsets of records in their file, and segments under a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.positions import block_of, running_totals
from fieldloom.session import written

SEGMENT_BYTES = 1024**3
#: Bytes of a file whose lines are ordered in one task.
STRETCH_BYTES = 64 << 20


def line_bytes(line: Column) -> Column:
    """Bytes a line takes in a file, its line feed included."""
    return (F.octet_length(line) + 1).cast("bigint")


def byte_offsets(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``byte_offset, byte_length`` to rows ``file_name, seq, line``."""
    located = running_totals(
        lines,
        by=["file_name"],
        order=["seq"],
        totals={"byte_offset": line_bytes(F.col(line))},
        block=block_of(F.col("seq")),
    )
    return located.withColumn("byte_length", F.octet_length(line).cast("bigint"))


def _next_starts(located: DataFrame, limit: int) -> DataFrame:
    """Where the next segment starts if one starts at a line: ``file_name, seq, next``.

    A segment that starts at a line is full at its offset plus the limit, or behind that line
    if it is longer. The next one starts with the line that holds this byte; a line
    whose segment reaches the end of the file has no row. Lines and full marks
    of one stretch of the file are ordered together; only the last line of each
    stretch is handed on to the stretches after it.
    """
    stretch = min(limit, STRETCH_BYTES)
    end = F.col("offset") + F.col("bytes")
    line = F.struct("offset", "seq", end.alias("end"))
    full = F.greatest(F.col("offset") + limit, end)
    lines = located.select("file_name", F.col("offset").alias("pos"), line.alias("line"), F.lit(None).cast("bigint").alias("seq"))
    asks = located.select("file_name", full.alias("pos"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), "seq")
    events = lines.unionByName(asks).withColumn("block", F.floor(F.col("pos") / stretch).cast("bigint"))

    blocks = events.groupBy("file_name", "block").agg(F.max("line").alias("last"))
    earlier = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_name", "block", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy("file_name", "block").orderBy("pos", F.col("seq").isNotNull())
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("met", F.last("line", ignorenulls=True).over(within)).where(F.col("seq").isNotNull())
    found = met.join(blocks, ["file_name", "block"]).withColumn("met", F.coalesce("met", "carried"))
    return found.where(F.col("met.end") > F.col("pos")).select("file_name", "seq", F.col("met.seq").alias("next"))


def segment_starts(located: DataFrame, limit: int) -> DataFrame:
    """The lines at which segments start: ``file_name, seq``.

    Each line knows the start of the next segment should one start there. These
    pointers are doubled: from the starts known so far, pointers over 1, 2, 4 ...
    segments lead to all the others, in as many rounds as the logarithm of the
    longest file's segments. Lines too near to the end for a pointer drop out.
    """
    starts = written(located.where("offset = 0").select("file_name", "seq"), "segment-starts")
    pointers = written(_next_starts(located, limit), "segment-pointers")
    while not (moved := starts.join(pointers, ["file_name", "seq"])).isEmpty():
        starts = written(starts.unionByName(moved.select("file_name", F.col("next").alias("seq"))), "segment-starts")
        onwards = pointers.select("file_name", F.col("seq").alias("next"), F.col("next").alias("_after"))
        doubled = pointers.join(onwards, ["file_name", "next"]).select("file_name", "seq", F.col("_after").alias("next"))
        pointers = written(doubled, "segment-pointers")
    return starts


def segment_plan(lines: DataFrame, limit: int = SEGMENT_BYTES, line: str = "line") -> DataFrame:
    """Assign every line to a segment, in file order and "until full".

    A line that would take its segment over ``limit`` bytes starts the next one; only
    a single line longer than the limit exceeds it. Rows are ``file_name, seq``
    (unique in a file) and the line. No task sees a whole file.
    """
    rows = lines.select("file_name", "seq", line_bytes(F.col(line)).alias("bytes"))
    located = running_totals(
        rows, by=["file_name"], order=["seq"], totals={"offset": F.col("bytes")}, block=block_of(F.col("seq"))
    )
    located = written(located, "located-lines")
    starts = segment_starts(located, limit).withColumn("start", F.lit(1))
    marked = located.join(starts, ["file_name", "seq"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    numbered = running_totals(
        marked, by=["file_name"], order=["seq"], totals={"before": F.col("start")}, block=block_of(F.col("seq"))
    )
    planned = numbered.select("file_name", "seq", "bytes", (F.col("before") + F.col("start")).alias("segment"))
    sizes = planned.groupBy("file_name", "segment").agg(F.sum("bytes").alias("segment_bytes"))
    return planned.join(sizes, ["file_name", "segment"]).select("file_name", "seq", "bytes", "segment", "segment_bytes")


def segment_names(file_name: Column, segment: Column) -> Column:
    """``people_part_0001.jsonl`` for segment 1 of ``people.jsonl``.

    A part number already in the name is kept, so names are never used twice.
    """
    stem = F.regexp_replace(file_name, r"\.jsonl\z", "")
    return F.concat(stem, F.lit("_part_"), F.lpad(segment.cast("string"), 4, "0"), F.lit(".jsonl"))
