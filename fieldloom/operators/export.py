"""Exports of search results, grouped by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.texts import csv_cell


def column_order(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per source the union of field names, in order of first appearance.

    Each name is reduced to its first place before names are gathered, so the
    gathered list is as long as the header line, whatever the number of records.
    """
    keys = [*by, "source_table"]
    cells = records.select(*keys, "seq", F.posexplode_outer(F.map_keys("fields")).alias("pos", "key"))
    cells = cells.where(F.col("key").isNotNull())
    firsts = cells.groupBy(*keys, "key").agg(F.min(F.struct("seq", "pos")).alias("place"))
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda e: e["key"]).alias("columns")
    )


def csv_lines(records: DataFrame, headers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """CSV lines per source: ``source_table, part, seq, line``; with ``by`` an export per query.

    Part 0 is the title, 1 the info, 2 the column line and 3 the records.
    Records of sources without a header are left out.
    """
    keys = [*by, "source_table"]
    columns = column_order(records, by)
    known = headers.select(*keys).distinct()
    cells = F.transform("columns", lambda k: csv_cell(F.col("fields")[k]))
    body = (
        records.join(columns, keys)
        .join(known, keys, "left_semi")
        .select(*keys, F.lit(3).alias("part"), "seq", F.array_join(cells, ",").alias("line"))
    )
    names = columns.join(known, keys, "left_semi").select(
        *keys,
        F.lit(2).alias("part"),
        F.lit(0).cast("bigint").alias("seq"),
        F.array_join(F.transform("columns", csv_cell), ",").alias("line"),
    )
    return _titles(headers, csv_cell, keys).unionByName(names).unionByName(body)


def text_lines(records: DataFrame, headers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Plain text per source: one ``key = value`` line per field."""
    keys = [*by, "source_table"]
    pairs = F.transform(
        F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("")))
    )
    known = headers.select(*keys).distinct()
    body = records.join(known, keys, "left_semi").select(
        *keys, F.lit(3).alias("part"), "seq", F.concat(F.array_join(pairs, "\n"), F.lit("\n")).alias("line")
    )
    return _titles(headers, lambda c: c, keys).unionByName(body)


#: Fixed values of export files.
BYTE_ORDER_MARK = "\ufeff"
NO_DATA = "No data"
GROUP_RULE = "-----------------------"


def csv_document(records: DataFrame, headers: DataFrame) -> DataFrame:
    """One CSV file of all sources: ``place, part, seq, line`` in this order.

    The first line begins with a byte order mark. Each source has its title, its info, an empty
    line, and its column line with the records, or a line that says there are none;
    an empty line stands between sources.
    """
    lines = csv_lines(records, headers).withColumn("part", F.when(F.col("part") >= 2, F.col("part") + 1).otherwise(F.col("part")))
    return _document(lines, records, headers, f'"{NO_DATA}"', "", BYTE_ORDER_MARK)


def text_document(records: DataFrame, headers: DataFrame) -> DataFrame:
    """One text file of all sources: ``place, part, seq, line`` in this order.

    As :func:`csv_document`, with an empty line after each record, no mark, and a rule between sources.
    """
    lines = text_lines(records, headers).withColumn("part", F.when(F.col("part") >= 2, F.col("part") + 1).otherwise(F.col("part")))
    return _document(lines, records, headers, f"{NO_DATA}\n", f"{GROUP_RULE}\n", "")


def _document(lines: DataFrame, records: DataFrame, headers: DataFrame, none: str, between: str, mark: str) -> DataFrame:
    """Lines of sources (parts 0, 1, 3, 4) with what stands around them.

    Sources are numbered in one window: a file has one heading per source.
    """
    order = Window.orderBy("source_table")
    places = headers.select("source_table").distinct().withColumn("place", F.row_number().over(order).cast("bigint"))
    empty = places.join(records.select("source_table").distinct(), "source_table", "left_anti")

    def fixed(rows: DataFrame, part: int, line: str) -> DataFrame:
        return rows.select("place", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.lit(line).alias("line"))

    body = lines.join(places, "source_table")
    first = (F.col("place") == 1) & (F.col("part") == 0)
    marked = F.when(first, F.concat(F.lit(mark), "line")).otherwise(F.col("line")).alias("line")
    return (
        body.select("place", "part", "seq", marked)
        .unionByName(fixed(places, 2, ""))
        .unionByName(fixed(empty, 3, none))
        .unionByName(fixed(places.where("place > 1").withColumn("place", F.col("place") - 1), 5, between))
    )


def _titles(headers: DataFrame, cell, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast("bigint").alias("seq")
    title = headers.select(*keys, F.lit(0).alias("part"), zero, F.concat(F.lit("Source: "), cell(F.col("name"))).alias("line"))
    info = headers.where(F.coalesce("info", F.lit("")) != "").select(
        *keys, F.lit(1).alias("part"), zero, cell(F.col("info")).alias("line")
    )
    return title.unionByName(info)
