"""One query per operator over the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import Catalog, FieldSpec
from fieldloom.functions import fields as ff
from fieldloom.functions.blanks import strip
from fieldloom.functions.dates import day_text, day_value, epoch_moment, moment
from fieldloom.functions.texts import map_text
from fieldloom.functions.typed_input import is_acceptable, sanitize
from fieldloom.operators import batch, export, manifest, naming, profile, results, segments, sources
from fieldloom.operators.positions import block_of
from fieldloom.operators.postings import postings
from fieldloom.operators.records import documents, records_of, route, route_sides, shape_names
from fieldloom.operators.search import matching_ids, resolve
from fieldloom.session import shared_dir, written
from fieldloom.sources import json_folder, sinks
from fieldloom.sources.tables import (
    SOURCE_FIELDS,
    SOURCES,
    TABLE_CATALOG,
    all_records,
    day,
    source_rows,
    table,
    table_postings,
)
from fieldloom.store import RecordStore
from fieldloom.streaming.alerts import standing_hits, standing_wildcard_hits
from fieldloom.streaming.upkeep import append_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

REF = {"ref": "000-000-001"}
REF_RANGE = {"ref": "0000001%"}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


# -- search -------------------------------------------------------------------


def find(spark: SparkSession, sf_dir: str, asked: dict[str, str], strict: bool = False) -> DataFrame:
    """Ids found by a query; only the sources and columns it needs are read."""
    terms = resolve(spark, asked, TABLE_CATALOG, strict)
    used = {t.field for t in terms} or {spec.name for spec in TABLE_CATALOG}
    return matching_ids(table_postings(spark, sf_dir, used), terms)


def found_records(spark: SparkSession, sf_dir: str, asked: dict[str, str]) -> DataFrame:
    """Full records of a query's matches."""
    used = {t.field for t in resolve(spark, asked, TABLE_CATALOG)}
    names = [name for name, carried in SOURCE_FIELDS.items() if used <= carried]
    stored = documents(all_records(spark, sf_dir, names), TABLE_CATALOG).drop("raw")
    return results.result_records(results.fetch(stored, find(spark, sf_dir, asked)))


@query
def search_exact(spark, sf_dir):
    return find(spark, sf_dir, REF)


@query
def search_and(spark, sf_dir):
    return find(spark, sf_dir, {"ref": "(000) 000-001", "status": "F"})


@query
def search_wildcard(spark, sf_dir):
    return find(spark, sf_dir, {"ref": "000000?1%"})


@query
def search_phrase(spark, sf_dir):
    return find(spark, sf_dir, {"label": "small  w"})


@query
def search_widening(spark, sf_dir):
    return find(spark, sf_dir, {"ref": "none", "status": "F", "colour": "red"})


@query
def search_records(spark, sf_dir):
    found = found_records(spark, sf_dir, REF)
    return found.select("doc_id", "source_table", "seq", map_text(F.col("fields")).alias("fields"))


@query
def search_headers(spark, sf_dir):
    return results.result_headers(found_records(spark, sf_dir, REF), source_rows(spark, sf_dir))


@query
def search_stream(spark, sf_dir):
    found = written(found_records(spark, sf_dir, REF_RANGE), "search-stream")
    return results.result_stream(found, source_rows(spark, sf_dir))


@query
def search_page(spark, sf_dir):
    """The last full chunk of a stored stream, read by its cursor alone."""
    found = written(found_records(spark, sf_dir, REF_RANGE), "search-page")
    folder = shared_dir(spark, "search-page-stream")
    sinks.write_stream_rows(results.result_stream(found, source_rows(spark, sf_dir)), folder)
    stored = spark.read.parquet(folder)
    last = stored.agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0]
    return results.chunk_after(stored, last - results.CHUNK_ITEMS)


@query
def search_totals(spark, sf_dir):
    return results.result_totals(found_records(spark, sf_dir, REF_RANGE))


@query
def suggest_next(spark, sf_dir):
    return results.suggestions(found_records(spark, sf_dir, REF), {"ref": "000000001"}, TABLE_CATALOG)


@query
def facet_counts(spark, sf_dir):
    return results.facet_counts(found_records(spark, sf_dir, {"status": "F"}))


@query
def field_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("label"))
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return results.with_labels(sizes, "key", labels)


# -- batch search -------------------------------------------------------------


@query
def batch_search(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("query_id"), F.lit("ref").alias("field"), F.col("c_name").alias("value")
    )
    nations = table(spark, sf_dir, "nation").select(
        (-1 - F.col("n_nationkey")).cast("bigint").alias("query_id"), F.lit("nation").alias("field"), F.col("n_name").alias("value")
    )
    queries = names.unionByName(nations)
    terms = batch.query_terms(queries, TABLE_CATALOG)
    return batch.exact_hits(table_postings(spark, sf_dir, {"ref", "nation"}), terms)


def wildcard_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with and without a literal prefix, taken from the tables."""
    by_nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        F.lit("ref").alias("field"),
        F.format_string("%07d??", F.col("n_nationkey")).alias("value"),
    )
    word = F.regexp_extract("p_name", "[^ ]+$", 0)
    by_word = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("%"), word).alias("value")).agg(
        (F.min("p_partkey") + 1000).alias("query_id")
    )
    return by_nation.unionByName(by_word.select("query_id", F.lit("label").alias("field"), "value"))


@query
def batch_wildcard(spark, sf_dir):
    terms = batch.query_terms(wildcard_queries(spark, sf_dir), TABLE_CATALOG)
    return batch.wildcard_hits(table_postings(spark, sf_dir, {"ref", "label"}), terms)


@query
def batch_mixed(spark, sf_dir):
    """Exact and wildcard lines over many fields in one table of queries."""
    names = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).alias("query_id"), F.lit("ref").alias("field"), F.col("s_name").alias("value")
    )
    kinds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.min("event_id").alias("query_id"))
    kinds = kinds.select((F.col("query_id") + 20_000_000).alias("query_id"), F.lit("type").alias("field"), "value")
    queries = wildcard_queries(spark, sf_dir).unionByName(names).unionByName(kinds)
    return batch.batch_search(table_postings(spark, sf_dir, {"ref", "label", "type"}), queries, TABLE_CATALOG)


def infix_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that begin and end with a wildcard, or hold nothing else."""
    part = table(spark, sf_dir, "part")
    inner = part.groupBy(F.concat(F.lit("%"), F.substring("p_name", 3, 3), F.lit("?%")).alias("value")).agg(F.min("p_partkey").alias("query_id"))
    short = part.groupBy(F.concat(F.lit("?%"), F.substring("p_brand", 7, 1), F.lit("%")).alias("value")).agg(F.min("p_partkey").alias("query_id"))
    kinds = table(spark, sf_dir, "events").groupBy(F.regexp_replace("event_type", ".", "?").alias("value")).agg(F.min("event_id").alias("query_id"))
    return (
        inner.select((F.col("query_id") + 1_000_000).alias("query_id"), F.lit("label").alias("field"), "value")
        .unionByName(short.select((F.col("query_id") + 2_000_000).alias("query_id"), F.lit("brand").alias("field"), "value"))
        .unionByName(kinds.select((F.col("query_id") + 30_000_000).alias("query_id"), F.lit("type").alias("field"), "value"))
    )


@query
def batch_infix(spark, sf_dir):
    """Patterns without a literal beginning, joined by what stands inside or by length."""
    terms = batch.query_terms(infix_queries(spark, sf_dir), TABLE_CATALOG)
    return batch.wildcard_hits(table_postings(spark, sf_dir, {"label", "brand", "type"}), terms)


def line_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of one to three lines, one per customer."""
    customer = table(spark, sf_dir, "customer")
    number = F.col("c_custkey").alias("query_id")
    names = customer.select(number, F.lit("ref").alias("field"), F.col("c_name").alias("value"))
    done = customer.where("c_acctbal >= 0").select(number, F.lit("status").alias("field"), F.lit("F").alias("value"))
    years = customer.where("c_mktsegment = 'BUILDING'").select(number, F.lit("order_date").alias("field"), F.lit("%.2001").alias("value"))
    return names.unionByName(done).unionByName(years)


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table_postings(spark, sf_dir, {"ref", "status", "order_date"})
    return batch.batch_and(asked, line_queries(spark, sf_dir), TABLE_CATALOG)


def hit_records(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Full records per query of hits, of which only those found become documents."""
    hits = written(hits, "batch-hits")
    stored = documents(records_of(all_records(spark, sf_dir), hits), TABLE_CATALOG).drop("raw")
    return results.batch_records(stored, hits)


@query
def batch_and(spark, sf_dir):
    """Documents that meet every line of a query."""
    return line_hits(spark, sf_dir)


@query
def batch_records(spark, sf_dir):
    """Full records per query; a document that many queries find is fetched once."""
    found = hit_records(spark, sf_dir, line_hits(spark, sf_dir))
    return found.select("query_id", "doc_id", "source_table", "seq", map_text(F.col("fields")).alias("fields"))


@query
def batch_headers(spark, sf_dir):
    """Per query the sources met, with their records."""
    found = hit_records(spark, sf_dir, line_hits(spark, sf_dir))
    return results.result_headers(found, source_rows(spark, sf_dir), by=("query_id",))


@query
def batch_export(spark, sf_dir):
    """A list of values in a text file, one search per line, one export per search."""
    folder = shared_dir(spark, "query-list")
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("  "), "s_name")).write.text(folder)
    asked = written(json_folder.read_queries(spark, folder, "ref"), "query-list-rows")
    hits = batch.batch_and(table_postings(spark, sf_dir, {"ref"}), asked, TABLE_CATALOG)
    found = written(hit_records(spark, sf_dir, hits), "batch-export")
    headers = results.result_headers(found, source_rows(spark, sf_dir), by=("query_id",))
    lines = export.csv_lines(found, headers, by=("query_id",))
    return lines.join(asked.select("query_id", F.trim("value").alias("value")), "query_id").drop("query_id")


# -- index --------------------------------------------------------------------


@query
def search_during_build(spark, sf_dir):
    """What a search finds while documents arrive in waves and a stream takes them up."""
    store = RecordStore(spark, shared_dir(spark, "waves"), TABLE_CATALOG)
    checkpoint = shared_dir(spark, "waves-checkpoint")
    steps = []
    for number, names in enumerate((["customer", "orders"], ["supplier", "part", "events", "documents"]), 1):
        store.append(all_records(spark, sf_dir, names))
        steps.append(written(store.find(REF).withColumn("step", F.lit(f"wave {number} arrived")), "wave"))
        store.index_stream(checkpoint).awaitTermination()
        steps.append(written(store.find(REF).withColumn("step", F.lit(f"wave {number} indexed")), "wave"))
    return reduce(DataFrame.unionByName, steps)


@query
def index_upkeep(spark, sf_dir):
    """Counts kept over several runs, a replaced source and merged parts, beside what readers count."""
    store = RecordStore(spark, shared_dir(spark, "upkeep"), TABLE_CATALOG)
    for names in (["customer", "supplier", "part"], ["orders"], ["events", "documents"]):
        store.append(all_records(spark, sf_dir, names))
        store.build_index(fan=3)
    kept = all_records(spark, sf_dir, ["orders"]).where(F.col("raw")["status"] == "F")
    sinks.replace_sources(documents(kept, TABLE_CATALOG), f"{store.root}/documents")
    store.build_index(on_change="replace", fan=3)
    read = profile.shard_stats(store.postings).withColumnRenamed("n", "found")
    return store.shard_stats.join(read, ["field", "shard"], "full_outer")


@query
def staged_publish(spark, sf_dir):
    """Shard counts of a store of all sources, after a staged and published run."""
    store = RecordStore(spark, shared_dir(spark, "published"), TABLE_CATALOG)
    store.append(all_records(spark, sf_dir))
    store.publish(*store.stage_index())
    return store.shard_stats


@query
def postings_build(spark, sf_dir):
    return table_postings(spark, sf_dir)


REGISTRY["postings"] = REGISTRY.pop("postings_build")


@query
def shard_stats(spark, sf_dir):
    return profile.shard_stats(table_postings(spark, sf_dir))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sizes of shards, from one pass over the postings."""
    both = table_postings(spark, sf_dir).groupBy("field", "shard").agg(
        F.count("*").alias("n"), F.sum(profile.entry_bytes()).alias("bytes")
    )
    return both


@query
def shard_profile(spark, sf_dir):
    return profile.shard_profile(_shards(spark, sf_dir))


@query
def shard_drift(spark, sf_dir):
    """Counts of an index that is behind beside sizes of what is there now: shards of either side."""
    counted = profile.shard_stats(table_postings(spark, sf_dir, {"label", "brand", "ref", "status"}))
    sizes = profile.shard_sizes(table_postings(spark, sf_dir, {"ref", "email", "status", "nation"}))
    return profile.shards_with_sizes(counted, sizes)


@query
def hot_shards(spark, sf_dir):
    return profile.hot_shards(_shards(spark, sf_dir))


@query
def doc_shards(spark, sf_dir):
    return profile.document_shards(documents(all_records(spark, sf_dir), TABLE_CATALOG))


@query
def index_summary(spark, sf_dir):
    return profile.index_summary(table_postings(spark, sf_dir))


@query
def sample_stats(spark, sf_dir):
    stats = profile.sample_stats(table(spark, sf_dir, "events"), "event_type", "value")
    return stats.select("event_type", "samples", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


# -- normalisation ------------------------------------------------------------


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, row, value``: values of every field, in untidy spellings."""
    def rows(name: str, key: str, field: str, value) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row"), value.alias("value"))

    spaced = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("\t"))
    return (
        rows("customer", "c_custkey", "ref", F.concat(F.lit(" +"), F.substring("c_name", 10, 3), F.lit("-"), F.substring("c_name", 13, 6)))
        .unionByName(rows("part", "p_partkey", "label", spaced))
        .unionByName(rows("orders", "o_orderkey", "brand", F.lower("o_orderpriority")))
        .unionByName(rows("orders", "o_orderkey", "order_date", dated_text()))
        .unionByName(rows("customer", "c_custkey", "email", F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Mail.Example.COM"))))
        .unionByName(rows("events", "event_id", "user", F.concat(F.lit("u"), F.col("user_id").cast("string"))))
        .unionByName(rows("events", "event_id", "type", F.col("event_type")))
        .unionByName(rows("events", "event_id", "k", F.concat(F.lit("k "), F.get_json_object("props", "$.k"))))
        .unionByName(rows("customer", "c_custkey", "segment", F.concat(F.lower("c_mktsegment"), F.lit("!"))))
        .unionByName(rows("nation", "n_nationkey", "nation", F.concat(F.lit("\n"), F.col("n_name"))))
        .unionByName(rows("orders", "o_orderkey", "status", F.concat(F.col("o_orderstatus"), F.lit("?"))))
        .unionByName(rows("documents", "doc_id", "lang", F.col("lang")))
        .unionByName(rows("documents", "doc_id", "source", F.concat(F.lit(" "), F.col("source"))))
    )


def dated_text():
    """An order date in one of five spellings, by priority."""
    return (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(F.col("o_orderpriority").startswith("2"), F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderpriority").startswith("3"), F.date_format("o_orderdate", "dd-MM-yyyy"))
        .when(F.col("o_orderpriority").startswith("4"), day("o_orderdate"))
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    )


@query
def norm_terms(spark, sf_dir):
    values = typed_values(spark, sf_dir).withColumn("value", strip(F.col("value")))
    term = ff.by_field(TABLE_CATALOG, F.col("field"), lambda s: ff.index_term(s, F.col("value")))
    return values.select("field", "row", term.alias("term"))


@query
def norm_date(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", dated_text().alias("given"))
    shown = dated.select("o_orderkey", "given", day_text(F.col("given")).alias("day"))
    return shown.select("*", F.date_format(day_value(F.col("day")), "yyyy-MM-dd").alias("calendar_day"))


@query
def norm_exact(spark, sf_dir):
    """Codes of fixed lengths: only digits, in an accepted number."""
    catalog = Catalog(
        (
            FieldSpec("eleven", "digits_exact", lengths=(11,)),
            FieldSpec("ten_or_twelve", "digits_exact", lengths=(10, 12)),
            FieldSpec("ten", "digits_exact", lengths=(10,)),
        )
    )
    customer = table(spark, sf_dir, "customer")
    size = (9 + F.length("c_mktsegment") % 5).cast("int")
    code = F.concat(F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), size, "7"), F.when(F.col("c_acctbal") < 0, "-").otherwise(""))
    coded = customer.select("c_custkey", code.alias("given"), F.explode(F.array(*[F.lit(s.name) for s in catalog])).alias("field"))
    coded = coded.withColumn("value", strip(F.col("given")))
    clean = ff.by_field(catalog, F.col("field"), lambda s: ff.clean_value(s, F.col("value")))
    term = ff.by_field(catalog, F.col("field"), lambda s: ff.index_term(s, F.col("value")))
    return coded.select("c_custkey", "field", "given", clean.alias("clean"), term.alias("term"))


def stamped_text():
    """An order date as sources write dates, by priority."""
    day_only = day("o_orderdate")
    return (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(F.col("o_orderpriority").startswith("2"), F.concat(F.lit(" "), day_only, F.lit("T10:20:30Z")))
        .when(F.col("o_orderpriority").startswith("3"), F.concat(day_only, F.lit(" or so")))
        .when(F.col("o_orderpriority").startswith("4"), F.lit("soon"))
        .otherwise(F.lit(""))
    )


@query
def source_moments(spark, sf_dir):
    """Dates in the spellings of source descriptions; epoch numbers where there is no text."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", stamped_text().alias("given"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("epoch"))
    when = F.when(F.col("given") == "", epoch_moment(F.col("epoch"))).otherwise(moment(F.col("given")))
    return rows.select("o_orderkey", "given", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query
def extract_numbers(spark, sf_dir):
    runs = ff.mined_digit_runs(TABLE_CATALOG["ref"], F.col("text"))
    mined = table(spark, sf_dir, "documents").select("doc_id", runs.alias("runs"))
    return mined.select("doc_id", F.size("runs").cast("bigint").alias("found"), F.array_join("runs", ",").alias("runs"))


@query
def query_terms(spark, sf_dir):
    plain = typed_values(spark, sf_dir)
    holes = F.replace(F.col("value"), F.lit("1"), F.lit("?"))
    asked = plain.unionByName(plain.where("field in ('ref', 'email')").withColumn("value", F.concat(holes, F.lit("_%"))))
    termed = batch.query_terms(asked, TABLE_CATALOG)
    return termed.select(
        "field",
        "row",
        "term",
        "wildcard",
        ff.literal_prefix(F.col("term")).alias("prefix"),
        ff.like_pattern(F.col("term")).alias("pattern"),
    )


@query
def sanitize_terms(spark, sf_dir):
    typed = typed_values(spark, sf_dir)
    clean = ff.by_field(TABLE_CATALOG, F.col("field"), lambda s: sanitize(s, F.col("value")))
    return typed.select("field", "row", clean.alias("value"))


@query
def validate_queries(spark, sf_dir):
    typed = typed_values(spark, sf_dir).withColumn("value", strip(F.col("value")))
    fine = ff.by_field(TABLE_CATALOG, F.col("field"), lambda s: is_acceptable(s, F.col("value")))
    return typed.select("field", "row", fine.alias("acceptable"))


# -- records ------------------------------------------------------------------


@query
def shape_name(spark, sf_dir):
    shaped = SOURCES["part"](spark, sf_dir).select("seq", shape_names(F.col("raw"), TABLE_CATALOG.names).alias("shaped"))
    return shaped.select("seq", F.col("shaped")["label"].alias("label"), F.array_join(F.map_keys("shaped"), ",").alias("keys"))


@query
def route_fields(spark, sf_dir):
    shaped = all_records(spark, sf_dir).withColumn("shaped", shape_names(F.col("raw"), TABLE_CATALOG.names))
    routed, known = route(F.col("shaped"), TABLE_CATALOG)
    fields, invalid = route_sides(F.col("routed"), known)
    split = shaped.withColumn("routed", routed).select("source_table", "seq", fields.alias("fields"), invalid.alias("invalid"))
    return split.select(
        "source_table",
        "seq",
        map_text(F.col("fields")).alias("fields"),
        F.size("invalid").cast("bigint").alias("invalid_fields"),
        F.md5(map_text(F.col("invalid"))).alias("invalid_md5"),
    )


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per order with its lines, in a layout set by priority.

    An order has a handful of lines, so the gathered lists are short. The id is
    left out, empty or given, by return flag.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag").alias("at"),
        F.concat(
            F.lit('{"part": '),
            F.col("l_partkey").cast("string"),
            F.when(F.col("l_returnflag") == "A", F.concat(F.lit(', "id": '), F.col("l_suppkey").cast("string")))
            .when(F.col("l_returnflag") == "R", F.lit(', "id": null'))
            .otherwise(F.lit("")),
            F.lit(', "note": "a} {b"}'),
        ).alias("record"),
    )
    gathered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "record"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = gathered.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Only arrays keep braces inside text apart; the other layouts go without.
    noted = F.transform("lines", lambda e: e["record"])
    bare = F.transform(noted, lambda r: F.replace(r, F.lit("a} {b"), F.lit("ab")))
    content = (
        F.when(F.col("o_orderpriority") < "3", F.concat(F.lit(" ["), F.array_join(noted, ", "), F.lit("]\n")))
        .when(F.col("o_orderpriority") < "4", F.array_join(bare, "\n"))
        .when(F.col("o_orderpriority") < "5", F.array_join(bare, ""))
        .otherwise(F.concat(F.lit("\n"), F.array_join(bare, "\n\n"), F.lit("\n")))
    )
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return joined.select(name.alias("file_name"), F.col("o_orderkey").alias("order_key"), content.alias("content"))


@query
def ingest_layouts(spark, sf_dir):
    rows = json_folder.records_of(order_files(spark, sf_dir), ["file_name"])
    return rows.select("file_name", "seq", F.col("raw")["part"].alias("part"), F.col("raw")["note"].alias("note"))


@query
def file_record_counts(spark, sf_dir):
    return json_folder.file_record_counts(json_folder.records_of(order_files(spark, sf_dir), ["file_name"]))


@query
def doc_ids(spark, sf_dir):
    rows = json_folder.records_of(order_files(spark, sf_dir), ["file_name"])
    named = rows.withColumn("source_table", naming.base_source_name(F.col("file_name")))
    return documents(named, TABLE_CATALOG).select("doc_id", "source_table", "row_id", "seq")


@query
def json_fields(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return parsed.select(
        "event_id",
        F.array_join(F.map_keys("props"), ",").alias("keys"),
        F.col("props")["k"].alias("k"),
        F.map_contains_key("props", "k").alias("has_k"),
        F.to_json("props").alias("props"),
    )


def _customer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.to_json(
            F.struct(
                F.col("c_custkey").alias("id"),
                F.col("c_name").alias("ref"),
                F.col("c_mktsegment").alias("segment"),
                F.col("c_nationkey").alias("nation"),
            )
        ).alias("value")
    )


@query
def ingest_scan(spark, sf_dir):
    """Customers written as whole JSON files, listed, checked and read back."""
    folder = shared_dir(spark, "scan")
    _customer_json(spark, sf_dir).write.option("lineSep", "\n").option("maxRecordsPerFile", 100_000).text(folder)
    return _customer_fields(json_folder.read_records(spark, folder, glob="part-*"))


def _customer_fields(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("raw")[name].alias(name) for name in ("id", "ref", "segment", "nation")])


@query
def ingest_jsonl(spark, sf_dir):
    """Customers written as JSON lines and read back in splits."""
    folder = shared_dir(spark, "lines")
    _customer_json(spark, sf_dir).write.option("maxRecordsPerFile", 1_000_000).text(folder)
    return _customer_fields(json_folder.read_json_lines(spark, folder, glob="part-*"))


# -- files, segments, manifests -------------------------------------------------


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit('{"id": '), key, F.lit(', "priority": "'), F.col("o_orderpriority"), F.lit('"}'))
    name = F.concat(F.lit("orders_"), F.col("o_orderstatus"), F.lit(".jsonl"))
    return table(spark, sf_dir, "orders").select(name.alias("file_name"), F.col("o_orderkey").alias("seq"), line.alias("line"))


@query
def byte_offsets(spark, sf_dir):
    located = segments.byte_offsets(order_lines(spark, sf_dir))
    return located.select("file_name", "seq", "byte_offset", "byte_length")


@query
def segment_plan(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit(".jsonl")).alias("file_name"), F.col("doc_id").alias("seq"), F.col("text").alias("line")
    )
    planned = segments.segment_plan(lines, limit=40_000)
    return planned.withColumn("part_name", segments.segment_names(F.col("file_name"), F.col("segment")))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feed files, one per customer: as of mid 2001, and of today's solvent customers."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    feeds = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.concat("c_name", F.lit(".jsonl")).alias("file_name")).agg(
            F.sum(F.octet_length("o_orderpriority")).cast("bigint").alias("size"),
            F.max("o_orderdate").alias("mtime"),
            F.count("*").alias("n_docs"),
        )

    earlier = feeds.where(F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp_ntz"))
    return listed(earlier), listed(feeds.where("c_acctbal >= 0"))


@query
def manifest_diff(spark, sf_dir):
    return manifest.manifest_diff(*manifests(spark, sf_dir))


@query
def build_mode(spark, sf_dir):
    return manifest.build_mode(manifest.manifest_diff(*manifests(spark, sf_dir)))


@query
def stage_check(spark, sf_dir):
    before, now = manifests(spark, sf_dir)
    return manifest.may_promote(before, now, now.select("file_name"))


# -- sources ------------------------------------------------------------------


@query
def source_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.select(F.col("p_partkey").alias("file_no"), F.concat("p_name", F.lit(".json")).alias("file_name"))
    underscored = F.replace("p_name", F.lit(" "), F.lit("_"))
    existing = part.where("p_size = 1").select(underscored.alias("source_table")).unionByName(
        part.where("p_size = 2").select(F.concat(underscored, F.lit("_3")).alias("source_table"))
    )
    return naming.unique_source_names(files, existing, ["file_no"], block_of(F.col("file_no")))


@query
def export_sheet_names(spark, sf_dir):
    groups = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" / "), "p_type", F.lit(" [all] of the year")).alias("title")
    )
    named = naming.unique_sheet_names(groups, "title", ["p_partkey"], block_of(F.col("p_partkey")))
    return named.select("p_partkey", "title", "sheet_name")


@query
def source_rows_build(spark, sf_dir):
    files = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("documents_imported"))
        .select(
            F.format_string("Feed %09d.json", F.col("o_custkey")).alias("file_name"),
            naming.base_source_name(F.format_string("Feed %09d.json", F.col("o_custkey"))).alias("source_table"),
            "documents_imported",
        )
    )
    metadata = table(spark, sf_dir, "supplier").select(
        F.format_string("FEED %09d.JSON", F.col("s_suppkey")).alias("file_name"),
        F.concat(F.lit(" "), "s_name").alias("name"),
        F.lit(" ").alias("description"),
        F.when(F.col("s_acctbal") > 0, "supplier").alias("type"),
        F.col("s_suppkey").alias("priority"),
    )
    return sources.new_source_rows(files, metadata, default_name="Feeds", default_type="feed")


REGISTRY["source_rows"] = REGISTRY.pop("source_rows_build")


@query
def sources_upsert(spark, sf_dir):
    def rows(name: str, prefix: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.regexp_extract(f"{prefix}_name", "[0-9]+", 0).alias("source_table"),
            F.col(f"{prefix}_name").alias("name"),
            F.col(f"{prefix}_nationkey").alias("nation"),
        )

    incoming = rows("supplier", "s").withColumn("priority", F.lit(0)).unionByName(
        rows("supplier", "s").where("nation < 5").withColumns({"name": F.lower("name"), "priority": F.lit(1)})
    )
    return sources.upsert_sources(rows("customer", "c"), incoming)


def order_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per customer: the feed of its orders."""
    customer = table(spark, sf_dir, "customer")
    feeds = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("documents_imported"),
            day_or_null(F.min("o_orderdate")).alias("created_at"),
            day_or_null(F.max("o_orderdate")).alias("imported_at"),
        )
    )
    solvent = F.col("c_acctbal") >= 0
    return customer.join(feeds, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("feed_"), F.col("c_custkey").cast("string")).alias("source_table"),
        F.concat(F.col("c_name"), F.lit(".json")).alias("file_name"),
        F.when(solvent, F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("type"),
        F.col("c_nationkey").alias("access_level"),
        F.when(F.col("documents_imported").isNotNull(), F.col("documents_imported")).alias("documents_imported"),
        "created_at",
        "imported_at",
        F.when(~solvent, F.lit(False)).alias("trust"),
        F.when(solvent, F.create_map(F.lit("email"), F.lit(False))).alias("search_fields"),
    )


def day_or_null(value):
    return F.date_format(value, "yyyy-MM-dd")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.catalog_rows(order_feeds(spark, sf_dir), [s.name for s in TABLE_CATALOG.indexed])


@query
def catalog_rows(spark, sf_dir):
    return _catalog(spark, sf_dir)


@query
def catalog_filter(spark, sf_dir):
    return sources.filter_type(_catalog(spark, sf_dir), "MACHINERY").select("name_table", "name", "type", "count")


@query
def catalog_sorted(spark, sf_dir):
    return sources.sort_rows(_catalog(spark, sf_dir), "count", descending=True).select("name_table", "count")


@query
def catalog_by_name(spark, sf_dir):
    """Catalogue rows numbered in dictionary order of their names."""
    ordered = sources.sort_rows(_catalog(spark, sf_dir), "name")
    return sources.numbered(ordered, "name").select("place", "name_table", "name")


@query
def catalog_totals(spark, sf_dir):
    return sources.catalog_totals(sources.filter_type(_catalog(spark, sf_dir), "MACHINERY"))


@query
def catalog_types(spark, sf_dir):
    return sources.catalog_types(order_feeds(spark, sf_dir))


@query
def timeline_rows(spark, sf_dir):
    """Dated catalogue rows, shown newest first."""
    rows = sources.timeline_rows(_catalog(spark, sf_dir))
    return rows.select("year", "month", "day", "shown_date", "name", "records")


@query
def update_timeline(spark, sf_dir):
    months = sources.timeline_months(sources.timeline_rows(_catalog(spark, sf_dir)))
    return months.select("year", "month", "sources", "records", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


# -- streaming ----------------------------------------------------------------


def _record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all sources, arriving."""
    return all_records(spark, sf_dir, stream=True)


def _run_stream(spark: SparkSession, rows: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    folder = shared_dir(spark, purpose)
    append_stream(rows, f"{folder}/out", f"{folder}/checkpoint", partition_by).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def stream_postings(spark, sf_dir):
    arriving = postings(documents(_record_stream(spark, sf_dir), TABLE_CATALOG), TABLE_CATALOG)
    written = _run_stream(spark, arriving, "stream-postings", ["field"])
    return written.select("field", "shard", "term", "doc_id", "source_table", "row_id")


@query
def stream_alerts(spark, sf_dir):
    arriving = postings(documents(_record_stream(spark, sf_dir), TABLE_CATALOG), TABLE_CATALOG)
    queries = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.lit("ref").alias("field"), F.col("s_name").alias("value")
    )
    return _run_stream(spark, standing_hits(arriving, queries, TABLE_CATALOG), "stream-alerts")


@query
def stream_wildcard_alerts(spark, sf_dir):
    arriving = postings(documents(_record_stream(spark, sf_dir), TABLE_CATALOG), TABLE_CATALOG)
    queries = wildcard_queries(spark, sf_dir)
    return _run_stream(spark, standing_wildcard_hits(arriving, queries, TABLE_CATALOG), "stream-wildcards")


# -- export -------------------------------------------------------------------


@query
def export_rows(spark, sf_dir):
    found = written(found_records(spark, sf_dir, REF_RANGE), "export")
    headers = results.result_headers(found, source_rows(spark, sf_dir)).where("source_table <> 'supplier'")
    return export.csv_lines(found, headers)


@query
def export_text(spark, sf_dir):
    found = written(found_records(spark, sf_dir, REF_RANGE), "export")
    headers = results.result_headers(found, source_rows(spark, sf_dir))
    return export.text_lines(found, headers)




def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of a search, and headings of all sources, also of those it did not meet."""
    found = written(found_records(spark, sf_dir, REF), "export")
    met = results.result_headers(found, source_rows(spark, sf_dir))
    others = source_rows(spark, sf_dir).join(met, "source_table", "left_anti")
    return found, met.drop("records").unionByName(others.select("source_table", *results.header_columns()))


@query
def export_csv_file(spark, sf_dir):
    """A whole CSV file, with the sources that a search did not meet."""
    return export.csv_document(*_export(spark, sf_dir))


@query
def export_text_file(spark, sf_dir):
    """A whole text file, with the sources that a search did not meet."""
    return export.text_document(*_export(spark, sf_dir))
