"""Headline timings: one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores. The
store is built from the tables once to warm up and once measured. Searches then
run over the stored index: after one warm-up, the median of five runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import batch, profile
from fieldloom.operators.results import result_stream
from fieldloom.session import build_session, shared_dir, written
from fieldloom.plans.queries import wildcard_queries
from fieldloom.sources.tables import TABLE_CATALOG, all_records, source_rows, table, table_postings
from fieldloom.store import RecordStore

RUNS = 5
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df: DataFrame) -> None:
    """Run a plan to its last row without keeping the result."""
    df.write.format("noop").mode("overwrite").save()


def seconds(action: Callable[[], None]) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def median_seconds(action: Callable[[], None]) -> float:
    action()
    return statistics.median(seconds(action) for _ in range(RUNS))


def json_folder(spark: SparkSession) -> str:
    """All orders as JSON files, to be imported."""
    folder = shared_dir(spark, "bench-incoming")
    rows = table(spark, SF_DIR, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.format_string("Customer#%09d", F.col("o_custkey")).alias("ref"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )
    rows.write.json(folder)
    return folder


def main() -> None:
    spark = build_session("fieldloom-bench", CPUS)
    times: dict[str, float] = {}
    incoming = json_folder(spark)
    for _ in ("warm-up", "measured"):
        fresh = RecordStore(spark, shared_dir(spark, "bench-import"), TABLE_CATALOG)
        times["import_folder"] = seconds(lambda s=fresh: s.import_folder(incoming))
        store = RecordStore(spark, shared_dir(spark, "bench"), TABLE_CATALOG)
        times["import_documents"] = seconds(lambda s=store: s.append(all_records(spark, SF_DIR)))
        times["build_index"] = seconds(store.build_index)

    customers = table(spark, SF_DIR, "customer").select(
        F.col("c_custkey").alias("query_id"), F.lit("ref").alias("field"), F.col("c_name").alias("value")
    )
    sources = written(source_rows(spark, SF_DIR), "bench-sources")
    exact = batch.query_terms(customers, TABLE_CATALOG)
    wild = batch.query_terms(wildcard_queries(spark, SF_DIR), TABLE_CATALOG)
    headline: dict[str, Callable[[], None]] = {
        "postings": lambda: drain(table_postings(spark, SF_DIR)),
        "shard_stats": lambda: drain(profile.shard_stats(store.postings)),
        "search_exact": lambda: drain(store.search({"ref": "000-000-001"})),
        "search_and": lambda: drain(store.search({"ref": "000-000-001", "status": "F"})),
        "search_wildcard": lambda: drain(store.search({"ref": "0000001?%"})),
        "search_phrase": lambda: drain(store.search({"label": "small w"})),
        "search_stream": lambda: drain(
            result_stream(written(store.search({"ref": "0000001%"}), "bench-results"), sources)
        ),
        "batch_search": lambda: drain(batch.exact_hits(store.postings, exact)),
        "batch_wildcard": lambda: drain(batch.wildcard_hits(store.postings, wild)),
    }
    for name, action in headline.items():
        times[name] = median_seconds(action)

    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in times.items()},
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
