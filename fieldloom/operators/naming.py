"""Unique names for sources and worksheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.blanks import strip
from fieldloom.functions.texts import sheet_base_name
from fieldloom.operators.positions import block_of, running_totals
from fieldloom.session import written

NAME_LENGTH = 120
SHEET_LENGTH = 31
# A sheet name keeps this much of its base for numbers of up to six digits.
SHEET_STEM = 24


def base_source_name(file_name: Column) -> Column:
    """A table name from a file name: no extension, safe characters only.

    A name of which nothing is left stops the job.
    """
    stem = strip(F.regexp_replace(file_name, r"(?<=.)\.[^.]*\z", ""))
    name = F.substring(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), 1, NAME_LENGTH)
    refused = F.raise_error(F.concat(F.lit("no source name can be made from the file name "), file_name))
    return F.when(name == "", refused.cast("string")).otherwise(name)


def unique_source_names(files: DataFrame, existing: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Give each file a source name that no other file or source has.

    ``files`` has ``file_name`` and the order columns, ``existing`` has
    ``source_table``. The first file of a free base name gets it; others get
    ``_2``, ``_3``, ..., leaving out numbers that make up another name.
    """
    based = files.withColumn("base", base_source_name(F.col("file_name")))
    placed = running_totals(based, by=["base"], order=order, totals={"earlier": F.lit(1)}, block=block)
    taken = existing.select(F.col("source_table").alias("base")).distinct().withColumn("exists", F.lit(1))
    placed = placed.join(taken, "base", "left")
    placed = placed.withColumn("nth", F.col("earlier") + F.coalesce("exists", F.lit(0)) - 1).withColumn("stem", F.col("base"))
    names = based.select("base").unionByName(taken.select("base")).distinct()
    # What several later steps ask of the placed files is worked out once.
    numbered = _free_numbers(written(placed, "placed-names"), names, start=2, stem_length=None)
    name = F.when(F.col("nth") < 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("number").cast("string")))
    return numbered.select(*files.columns, name.alias("source_table"))


def unique_sheet_names(groups: DataFrame, name: str, order: list[str], block: Column) -> DataFrame:
    """Worksheet names: at most 31 characters, repeats numbered from 1.

    A numbered name is cut as far as its number needs. Repeats are counted over
    names that agree in the part no cut can touch, so cut names differ too.
    """
    based = groups.withColumn("base", sheet_base_name(F.col(name))).withColumn("_block", block)
    placed = running_totals(based, by=["base"], order=order, totals={"earlier": F.lit(1)}, block=F.col("_block"))
    repeat = F.when(F.col("earlier") > 0, 1).otherwise(0)
    placed = placed.withColumn("stem", F.substring("base", 1, SHEET_STEM))
    placed = running_totals(placed, by=["stem"], order=order, totals={"nth": repeat}, block=F.col("_block"))
    placed = placed.withColumn("nth", F.when(F.col("earlier") > 0, F.col("nth")).otherwise(-1))
    placed = written(placed, "placed-sheets")
    numbered = _free_numbers(placed, placed.select("base").distinct(), start=1, stem_length=SHEET_STEM)
    suffix = F.concat(F.lit("_"), F.col("number").cast("string"))
    cut = F.substring(F.col("base"), F.lit(1), F.lit(SHEET_LENGTH) - F.length(suffix))
    sheet = F.when(F.col("nth") < 0, F.col("base")).otherwise(F.concat(cut, suffix))
    return numbered.select(*groups.columns, sheet.alias("sheet_name"))


def _free_numbers(placed: DataFrame, names: DataFrame, start: int, stem_length: int | None) -> DataFrame:
    """Add ``number``: the nth number of a stem, from ``start``, that is free.

    ``placed`` has ``stem`` and ``nth`` (0, 1, ..., or -1 where no number is
    needed). A name such as ``people_7`` uses up number 7 of ``people``. The nth
    free number is ``start + nth`` plus the used numbers passed on the way; a
    used number is passed when at most ``nth`` free ones lie below it.
    """
    stem = F.regexp_extract("base", r"\A(.*)_[1-9][0-9]{0,17}\z", 1)
    used = names.select(
        (F.substring(stem, 1, stem_length) if stem_length else stem).alias("stem"),
        F.regexp_extract("base", r"\A.*_([1-9][0-9]{0,17})\z", 1).try_cast("bigint").alias("used"),
    )
    used = used.where(F.col("used") >= start).distinct()
    used = used.join(placed.where("nth >= 0").select("stem").distinct(), "stem", "left_semi")
    used = written(used, "used-numbers")
    ranked = running_totals(used, by=["stem"], order=["used"], totals={"below": F.lit(1)}, block=block_of(F.col("used")))
    passed = ranked.select("stem", (F.col("used") - start - F.col("below")).alias("at"), F.lit(1).alias("step"), "used")
    asking = placed.where("nth >= 0").select("stem", F.col("nth").alias("at")).distinct()
    passed = written(passed, "passed-numbers")
    asking = asking.select("stem", "at", F.lit(0).alias("step"), F.lit(-1).cast("bigint").alias("used"))
    line = running_totals(
        passed.unionByName(asking).withColumn("turn", 1 - F.col("step")),
        by=["stem"],
        order=["at", "turn", "used"],
        totals={"skipped": F.col("step")},
        block=block_of(F.col("at")),
    )
    numbers = line.where("step = 0").select("stem", F.col("at").alias("nth"), (F.col("at") + F.col("skipped") + start).alias("number"))
    return placed.join(numbers, ["stem", "nth"], "left")
