"""Work that must not grow beyond what the JVM compiles, or what a search asks for."""

import contextlib
import io
import re

import pytest
from helpers import CATALOG, records, rows
from pyspark.sql import functions as F

from fieldloom.operators import batch
from fieldloom.operators.postings import postings
from fieldloom.operators.records import documents, records_of
from fieldloom.plans import queries
from fieldloom.session import written
from fieldloom.sources.tables import TABLE_CATALOG
from fieldloom.streaming.upkeep import DOCUMENT_SCHEMA


def test_code_of_postings_is_small_enough_to_be_compiled(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT_SCHEMA).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{tmp_path}/docs").withColumn("file_id", F.xxhash64("doc_id"))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        postings(stored, TABLE_CATALOG, ("file_id",)).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    # HotSpot leaves methods over 8000 bytes to its interpreter.
    assert sizes and max(sizes) < 8000


def test_wildcards_unfold_only_the_fields_some_pattern_asks_for(spark, monkeypatch):
    terms = spark.createDataFrame([(1, "mail", "a%", True)], "query_id long, field string, term string, wildcard boolean")
    words = spark.createDataFrame([("mail", "abc"), ("mail", "bc"), ("number", "a1"), ("label", "a b")], "field string, term string")
    unfolded = []
    keys = batch.word_keys

    def noted(given, kinds):
        unfolded.append(given.select("field").distinct().collect())
        return keys(given, kinds)

    monkeypatch.setattr(batch, "word_keys", noted)
    found = batch.matched_terms(terms, words).select("query_id", "term").collect()
    assert [tuple(r) for r in found] == [(1, "abc")]
    assert [[r["field"] for r in seen] for seen in unfolded] == [["mail"]]


def test_a_pattern_of_many_queries_is_matched_once(spark, monkeypatch):
    """The terms of a line do not grow with the queries that hold it."""
    index = spark.createDataFrame(
        [(f, t, f"d:{i}", "d") for i in range(40) for f, t in (("ref", f"10000000{i:02d}"), ("order_date", f"{i % 20 + 10}.01.2001"))],
        "field string, term string, doc_id string, source_table string",
    )
    asked = [(q, "ref", f"10000000{q:02d}") for q in range(40)] + [(q, "order_date", "%.2001") for q in range(40)]
    asked += [(100, "order_date", "10.01.2001"), (100, "ref", "1000000000"), (101, "order_date", "11.01.2001"), (101, "ref", "1000000000")]
    asked += [(102, "order_date", "1?.01.2001"), (102, "order_date", "%.2001"), (103, "status", "F"), (103, "ref", "1000000000")]
    queries = spark.createDataFrame(asked, "query_id long, field string, value string")
    sizes = {}

    def noted(rows, purpose):
        sizes[purpose] = rows.count()
        return written(rows, purpose)

    monkeypatch.setattr(batch, "written", noted)
    found = {(r["query_id"], r["doc_id"]) for r in batch.batch_and(index, queries, TABLE_CATALOG).collect()}
    few = {(102, f"d:{i}") for i in range(40) if i % 20 < 10}
    assert found == {(q, f"d:{q}") for q in range(40)} | {(100, "d:0")} | few
    # 40 ref lines, two days, 20 terms of one pattern and 10 of the other, and F.
    assert sizes["batch-lines"] == 40 + 2 + 20 + 10 + 1


@pytest.mark.parametrize("name", ["batch_records", "batch_headers", "batch_export"])
def test_documents_are_made_of_found_records_only(spark, monkeypatch, name):
    """Records that no query of a batch finds, most of all, are not checked and unfolded."""
    sizes, hits = [], {}

    def noted(given, catalog):
        sizes.append(given.count())
        return documents(given, catalog)

    def kept(rows, purpose):
        hits[purpose] = written(rows, purpose)
        return hits[purpose]

    monkeypatch.setattr(queries, "documents", noted)
    monkeypatch.setattr(queries, "written", kept)
    found = queries.REGISTRY[name](spark, "/root/testdata/sf0.001")
    # Hits are made once, for the records and for the queries that found them.
    assert found.count() and sizes == [hits["batch-hits"].select("doc_id", "source_table").distinct().count()]
    assert sizes[0] < queries.all_records(spark, "/root/testdata/sf0.001").count()


def test_records_of_ids(spark):
    """Ids repeat, are of other sources, of no record, or of two; a record without an id has its number."""
    given = records(spark, [{"id": "7", "mail": "a@x.org"}, {"mail": "b@x.org"}, {"id": "7", "mail": "c@x.org"}, {"id": "", "mail": "d@x.org"}])
    given = given.unionByName(records(spark, [{"id": "7", "mail": "e@x.org"}], "others"))
    asked = [("people:7", "people"), ("people:7", "people"), ("people:2", "people"), ("people:9", "people"), ("others:7", "people")]
    ids = spark.createDataFrame([(1, *a) for a in asked], "query_id int, doc_id string, source_table string")
    left = records_of(given, ids)
    assert left.columns == given.columns
    assert rows(left, "source_table", "seq") == [("people", 1), ("people", 2), ("people", 3)]
    every = documents(given, CATALOG).join(ids, ["doc_id", "source_table"], "left_semi").select("doc_id", "seq", "fields")
    made = documents(left, CATALOG).select("doc_id", "seq", "fields")
    key = lambda r: (r["doc_id"], r["seq"])
    assert sorted(made.collect(), key=key) == sorted(every.collect(), key=key)
    assert records_of(given, ids.limit(0)).count() == 0
