"""JSON folders in any of four layouts to raw records.

A file holds an array of objects, one object, one object per line, or objects
one after another. Files of up to one split are read whole. Larger ones are read line by
line in splits; only those that turn out to hold something other than an object per
line are then read whole. A caller may set limits on the number and size of files; by
default there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.blanks import BLANK_CLASS, strip
from fieldloom.operators.positions import running_totals
from fieldloom.session import written

JSON_GLOB = "*.[jJ][sS][oO][nN]"
RECORDS = "array<map<string,string>>"
CLOSED = f"array<{RECORDS}>"


def list_files(spark: SparkSession, folder: str, glob: str = JSON_GLOB) -> DataFrame:
    """Manifest of a folder's plain files: ``file_name, path, size, mtime``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.regexp_extract("path", "[^/]*$", 0).alias("file_name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def check_limits(files: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files that break a limit, with the reason. Empty means go ahead."""
    reason = F.lit(None).cast("string")
    if max_bytes is not None:
        reason = F.when(F.col("size") > max_bytes, F.lit("too large"))
    if max_files is not None:
        total = files.agg(F.count("*")).scalar()
        reason = F.coalesce(reason, F.when(total > max_files, F.lit("too many files")))
    return files.select("file_name", "size", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_whole_files(spark: SparkSession, folder: str, glob: str = JSON_GLOB) -> DataFrame:
    """``file_name, path, size, content``: one row per file."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("content"),
    )


def _with_parsed(rows: DataFrame, array: Column, out: str) -> DataFrame:
    """Add the records of a text that is one JSON array and nothing else, or null.

    Spark's parser stops after the first root value. So the text is followed by
    an element with its own digest, which no text can hold, and both must be
    there: then nothing closed the array early and nothing came after it. Text, digest
    and parsed value are columns of their own stage, so a text is parsed once.
    """
    sealed = rows.withColumn("_array", array).withColumn("_seal", F.md5(F.col("_array").cast("binary")))
    closed = F.concat(F.lit("["), "_array", F.lit(',[{"seal":"'), "_seal", F.lit('"}]]'))
    parsed = sealed.withColumn("_parsed", F.from_json(closed, CLOSED))
    there = F.coalesce(F.get(F.get("_parsed", 1), 0)["seal"] == F.col("_seal"), F.lit(False))
    whole = F.when((F.size("_parsed") == 2) & there, F.get("_parsed", 0))
    return parsed.withColumn(out, whole).drop("_array", "_seal", "_parsed")


def parsed_files(files: DataFrame) -> DataFrame:
    """Files with a ``content`` column, and their records in ``_records``: null when unreadable.

    Plain JSON is tried first, then objects on lines of their own: a JSON text holds no line
    break, so braces inside text values survive in both. Only then are
    objects separated wherever they adjoin.
    """
    texts = files.withColumn("_text", strip(F.col("content")))
    text, none = F.col("_text"), F.col("_plain").isNull()
    enclosed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rows = _with_parsed(texts, enclosed, "_plain")
    for name, between in (("_lines", f"{BLANK_CLASS}*\\n{BLANK_CLASS}*"), ("_joined", f"{BLANK_CLASS}*")):
        separated = F.concat(F.lit("["), F.regexp_replace(text, r"\}" + between + r"\{", "},{"), F.lit("]"))
        rows = _with_parsed(rows, F.when(none & (text != ""), separated), name)
        none = none & F.col(name).isNull()
    records = F.when(text == "", F.array().cast(RECORDS)).otherwise(F.coalesce("_plain", "_lines", "_joined"))
    return rows.withColumn("_records", records).drop("_text", "_plain", "_lines", "_joined")


def last_entry_wins(raw: Column) -> Column:
    """A JSON object that repeats a key keeps the last value in the first place."""
    keys = F.array_distinct(F.map_keys(raw))
    values = F.transform(
        keys, lambda k: F.element_at(F.filter(F.map_entries(raw), lambda e: e["key"] == k), -1)["value"]
    )
    return F.when(F.size(keys) == F.size(F.map_keys(raw)), raw).otherwise(F.map_from_arrays(keys, values))


def records_of(files: DataFrame, keep: list[str]) -> DataFrame:
    """Rows ``*keep, seq, raw`` of files with a ``content`` column.

    ``seq`` counts from 1 in each file. A file that cannot be read fails the
    job; :func:`unreadable` lists such files beforehand.
    """
    parsed = parsed_files(files.select(*keep, "content"))
    checked = F.coalesce("_records", F.raise_error(F.lit("a file is not readable as JSON records")).cast(RECORDS))
    # The outer form keeps Spark from parsing twice to test for empty files.
    rows = parsed.select(*keep, F.posexplode_outer(checked).alias("pos", "raw")).where(F.col("pos").isNotNull())
    return rows.select(*keep, (F.col("pos") + 1).cast("bigint").alias("seq"), last_entry_wins(F.col("raw")).alias("raw"))


def unreadable(files: DataFrame) -> DataFrame:
    return parsed_files(files).where(F.col("_records").isNull()).select("file_name")


def read_records(
    spark: SparkSession,
    folder: str,
    glob: str = JSON_GLOB,
    named: DataFrame | None = None,
    split_bytes: int | None = None,
) -> DataFrame:
    """``file_name, seq, raw`` of a folder of JSON files of any layout.

    ``named`` has ``file_name`` and columns to add; files it leaves out are not read.
    A file over ``split_bytes`` (by default what Spark puts into one split) is read by
    several tasks when each of its lines is an object.
    """
    if split_bytes is None:
        split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    keep = ["file_name"] if named is None else named.columns

    def wanted(rows: DataFrame) -> DataFrame:
        return rows if named is None else rows.join(named, "file_name")

    whole, large = read_whole_files(spark, folder, glob), F.col("size") > split_bytes
    records = records_of(wanted(whole.where(~large)), keep)
    if list_files(spark, folder, glob).where(large).isEmpty():
        return records
    lines = written(_parsed_lines(spark, folder, glob).where(large).drop("line"), "parsed-lines")
    others = lines.where(F.col("raw").isNull()).select("file_name").distinct()
    by_line = _numbered(lines.join(others, "file_name", "left_anti"))
    by_line = wanted(by_line).select(*keep, "seq", last_entry_wins(F.col("raw")).alias("raw"))
    rest = records_of(wanted(whole.where(large).join(others, "file_name", "left_semi")), keep)
    return records.unionByName(by_line).unionByName(rest)


def _parsed_lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Lines with their file, place and record; ``raw`` is null where a line is no object."""
    lines = spark.read.option("pathGlobFilter", glob).text(folder)
    placed = lines.where(strip(F.col("value")) != "").select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )
    parsed = _with_parsed(placed, F.concat(F.lit("["), "line", F.lit("]")), "_records")
    one = F.when(F.size("_records") == 1, F.get("_records", 0))
    return parsed.withColumn("raw", one).drop("_records")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``seq``, counted by position in their file: no file is read as one."""
    numbered = running_totals(
        lines, by=["file_name"], order=["start", "place"], totals={"earlier": F.lit(1)}, block=F.col("start")
    )
    return numbered.withColumn("seq", F.col("earlier") + 1)


def read_json_lines(spark: SparkSession, folder: str, glob: str = "*", quarantine: bool = False) -> DataFrame:
    """``file_name, seq, raw`` of line-oriented files, which Spark may split.

    Blank lines are skipped. A malformed line fails the job, or with
    ``quarantine`` stays in the result with its text in ``broken`` and no record.
    """
    numbered = _numbered(_parsed_lines(spark, folder, glob))
    out = ["file_name", "seq"]
    broken = F.col("raw").isNull()
    if quarantine:
        return numbered.select(*out, last_entry_wins(F.col("raw")).alias("raw"), F.when(broken, F.col("line")).alias("broken"))
    stop = F.raise_error(F.lit("a line is not a JSON object")).cast("map<string,string>")
    return numbered.select(*out, last_entry_wins(F.coalesce("raw", stop)).alias("raw"))


def file_record_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("file_name").agg(F.count("*").alias("records"))


def read_queries(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A query list: each non-blank line is one value of one field."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(F.monotonically_increasing_id().alias("query_id"), F.lit(field).alias("field"), "value")
