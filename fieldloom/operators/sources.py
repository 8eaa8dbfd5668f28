"""The source dimension: rows for new files, upserts, catalogue, timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.blanks import null_if_empty, strip
from fieldloom.functions.dates import epoch_moment, first_filled, moment
from fieldloom.functions.texts import grouped_count, leading_int

DEFAULT_TYPE = "local-import"
UNKNOWN_TYPE = "unknown"


def new_source_rows(
    files: DataFrame,
    metadata: DataFrame,
    default_name: str = "",
    default_description: str = "",
    default_type: str = "",
) -> DataFrame:
    """Source rows of imported files.

    ``files`` has ``file_name, source_table, documents_imported``; ``metadata``
    has ``file_name, name, description, type`` and is matched without regard to
    case, the last row of a file name winning by ``priority``.
    """

    def text(name: str) -> Column:
        return null_if_empty(strip(F.col(name)))

    given = (
        metadata.withColumn("_key", F.lower(strip(F.col("file_name"))))
        .groupBy("_key")
        .agg(F.max_by(F.struct("name", "description", "type"), F.col("priority")).alias("_m"))
        .select("_key", *[null_if_empty(strip(F.col(f"_m.{c}"))).alias(f"_{c}") for c in ("name", "description", "type")])
    )
    n_files = files.agg(F.count("*")).scalar()
    wide_name = default_name.strip()
    if wide_name:
        several = F.concat(F.lit(wide_name), F.lit(" ("), F.col("source_table"), F.lit(")"))
        fallback = F.when(n_files <= 1, F.lit(wide_name)).otherwise(several)
    else:
        fallback = F.col("source_table")
    description = default_description.strip()
    generated = F.lit(description) if description else F.concat(F.lit("Imported from file "), F.col("file_name"))
    joined = files.join(given, F.lower(F.col("file_name")) == F.col("_key"), "left")
    return joined.select(
        *files.columns,
        F.coalesce("_name", fallback).alias("name"),
        F.coalesce("_description", generated).alias("description"),
        F.coalesce("_type", F.lit(default_type.strip() or DEFAULT_TYPE)).alias("type"),
    )


def upsert_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of both sides; an incoming row replaces the one of its name.

    ``incoming`` may bring a ``priority`` column for repeats within itself.
    """
    if "priority" not in incoming.columns:
        incoming = incoming.withColumn("priority", F.lit(0))
    both = current.withColumn("_rank", F.lit(-1).cast("bigint")).unionByName(
        incoming.withColumn("_rank", F.col("priority").cast("bigint")).drop("priority")
    )
    rest = [c for c in current.columns if c != "source_table"]
    last = both.groupBy("source_table").agg(F.max_by(F.struct(*rest), F.col("_rank")).alias("_last"))
    return last.select("source_table", "_last.*")


def catalog_rows(sources: DataFrame, search_fields: Sequence[str]) -> DataFrame:
    """The catalogue: every column as text, with the documented fallbacks.

    Expects ``source_table`` and any of the optional source columns; missing
    ones count as empty. Search flags come from the ``search_fields`` map.
    """

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in sources.columns else F.lit(None).cast(kind)

    def or_else(name: str, default: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit(default))

    imported = null_if_empty(column("imported_at").cast("string"))
    origin = F.concat(F.lit("Import from file "), null_if_empty(column("file_name")))
    flags = column("search_fields", "map<string,boolean>")
    return sources.select(
        F.col("source_table").alias("name_table"),
        F.coalesce(null_if_empty(column("name")), F.col("source_table")).alias("name"),
        F.coalesce(null_if_empty(column("description")), origin, F.lit("Local source")).alias("info"),
        or_else("country", "").alias("country"),
        or_else("access_level", "local").alias("access_level"),
        F.coalesce(column("documents_imported", "bigint"), column("record_count", "bigint"), F.lit(0))
        .cast("string")
        .alias("count"),
        *[F.coalesce(flags[f], F.lit(True)).cast("string").alias(f"search_{f}") for f in search_fields],
        F.coalesce(null_if_empty(column("type")), F.lit(DEFAULT_TYPE)).alias("type"),
        or_else("trust", "true").alias("trust"),
        F.coalesce(null_if_empty(column("updated_at").cast("string")), imported, F.lit("")).alias("updated_at"),
        F.coalesce(null_if_empty(column("created_at").cast("string")), imported, F.lit("")).alias("created_at"),
        F.coalesce(column("relevance_date").cast("string"), column("imported_at").cast("string"), F.lit("")).alias(
            "relevance_date"
        ),
    )


def source_type() -> Column:
    return F.coalesce("type", F.lit(UNKNOWN_TYPE))


def filter_type(rows: DataFrame, wanted: str | None) -> DataFrame:
    """Catalogue rows of one type; all rows when none is chosen."""
    return rows if wanted is None else rows.where(source_type() == wanted)


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sort by a column: ``count`` as a number, others in dictionary order."""
    return rows.orderBy(*_order(key, descending))


def numbered(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Add ``place``, a row's number in that order. One window: the catalogue has a row per source."""
    order = Window.orderBy(*_order(key, descending))
    return rows.withColumn("place", F.row_number().over(order).cast("bigint"))


def _order(key: str, descending: bool) -> list[Column]:
    place = leading_int(F.col("count")) if key == "count" else F.collate(F.coalesce(key, F.lit("")), "UNICODE")
    return [place.desc() if descending else place.asc(), F.col("name_table")]


def catalog_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(leading_int(F.col("count"))), F.lit(0)).alias("records")
    )


def catalog_types(rows: DataFrame) -> DataFrame:
    """The distinct types in order."""
    return rows.select(source_type().alias("type")).distinct().orderBy("type")


def timeline_rows(rows: DataFrame, epoch: str | None = None) -> DataFrame:
    """Dated catalogue rows, newest first, then by name.

    The date is the first filled of the update, creation and import columns;
    rows whose date cannot be read are left out. ``epoch`` names an optional
    column of milliseconds, used where the text columns are empty.
    """
    columns = [c for c in ("updated_at", "created_at", "imported_at", "relevance_date") if c in rows.columns]
    when = moment(first_filled(*[F.col(c) for c in columns]))
    if epoch is not None:
        when = F.coalesce(when, epoch_moment(F.col(epoch)))
    dated = rows.withColumn("moment", when).where(F.col("moment").isNotNull())
    return dated.select(
        F.year("moment").alias("year"),
        F.month("moment").alias("month"),
        F.dayofmonth("moment").alias("day"),
        F.date_format("moment", "dd.MM.yyyy").alias("shown_date"),
        "moment",
        F.coalesce(null_if_empty(F.col("name")), F.col("name_table")).alias("name"),
        F.coalesce(null_if_empty(F.col("type")), F.lit(DEFAULT_TYPE)).alias("type"),
        grouped_count(leading_int(F.col("count"))).alias("count"),
        leading_int(F.col("count")).alias("records"),
    ).orderBy(F.desc("moment"), "name")


def timeline_months(dated: DataFrame) -> DataFrame:
    """Sources and records per month."""
    return dated.groupBy("year", "month").agg(
        F.count("*").alias("sources"), F.sum("records").alias("records"), F.max("moment").alias("newest")
    )
