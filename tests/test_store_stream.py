import json

import pytest
from helpers import CATALOG, records, rows
from pyspark.sql import functions as F

from fieldloom.operators.postings import postings
from fieldloom.operators.records import documents
from fieldloom.session import shared_dir
from fieldloom.sources import sinks
from fieldloom.store import RecordStore
from fieldloom.streaming.alerts import standing_hits
from fieldloom.streaming.upkeep import append_stream, index_new_files, plan_run, read_document_stream


@pytest.fixture
def store(spark):
    return RecordStore(spark, shared_dir(spark, "store"), CATALOG)


def write(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(records), encoding="utf8")


def test_import_index_search(spark, store, tmp_path):
    first, second = tmp_path / "in1", tmp_path / "in2"
    write(first, "people.json", [{"id": 1, "number": "+7 (999) 123-45-67", "mail": "a@x.org"}, {"number": "79991230000"}])
    imported = store.import_folder(str(first), default_type="list")
    assert rows(imported, "source_table", "file_name", "type", "documents_imported") == [("people", "people.json", "list", 2)]

    run = store.build_index()
    assert (run["mode"], run["entries"]) == ("full", 3)
    assert rows(store.search({"number": "7 999 1234567"}), "doc_id") == [("people:1",)]
    assert rows(store.search({"number": "7999%"}), "doc_id") == [("people:1",), ("people:2",)]
    assert rows(store.search({"number": "7999%", "mail": "a@x.org"}), "doc_id") == [("people:1",)]
    assert store.search({"number": "1%"}).count() == 0

    assert store.build_index()["mode"] == "noop"

    write(second, "people.json", [{"id": 9, "mail": "b@x.org"}])
    again = store.import_folder(str(second))
    assert rows(again, "source_table", "name") == [("people_2", "people_2")]
    added = store.build_index()
    assert (added["mode"], added["entries"]) == ("incremental", 4)
    assert added["files_reused"] > 0 and added["version"] == run["version"]
    assert rows(store.search({"mail": "b@x.org"}), "doc_id") == [("people_2:9",)]
    rebuilt = postings(store.documents, CATALOG)
    columns = ["field", "shard", "term", "doc_id"]
    assert rows(store.postings, *columns) == rows(rebuilt, *columns)

    queries = spark.createDataFrame([(1, "mail", "b@x.org"), (2, "number", "79%")], "query_id bigint, field string, value string")
    assert rows(store.batch_search(queries), "query_id", "doc_id") == [(1, "people_2:9"), (2, "people:1"), (2, "people:2")]
    chunk = next(store.search_chunks({"number": "7999%"}))
    assert [r["kind"] for r in chunk] == ["header", "record", "record"]
    listed = {r["name_table"]: r["count"] for r in store.list_sources().collect()}
    assert listed == {"people": "2", "people_2": "1"}


def test_changed_files_ask_for_a_full_build(spark, store):
    store.append(records(spark, [{"id": "1", "mail": "a@x.org"}]))
    assert store.build_index()["mode"] == "full"
    longer = documents(records(spark, [{"id": "1", "mail": "a@x.org"}, {"id": "2", "mail": "b@x.org"}]), CATALOG)
    sinks.write_documents(longer, f"{store.root}/documents", mode="overwrite")
    run = store.build_index()
    assert (run["mode"], run["version"], run["entries"]) == ("full", 1, 2)
    assert rows(store.find({"mail": "%"}), "doc_id") == [("people:1",), ("people:2",)]


def test_import_stops_at_limits(spark, store, tmp_path):
    write(tmp_path / "in", "a.json", [{"id": 1}])
    with pytest.raises(ValueError, match="too large"):
        store.import_folder(str(tmp_path / "in"), max_bytes=3)
    assert store.documents.count() == 0 and store.sources.count() == 0


def test_more_hits_than_any_limit(spark, store):
    store.append(records(spark, [{"id": str(i), "mail": "same@x.org"} for i in range(501)]))
    store.build_index()
    assert store.search({"mail": "same@x.org"}).count() == 501


def test_file_that_arrives_during_a_build_is_indexed_by_the_next(spark, store):
    store.append(records(spark, [{"id": "1", "mail": "a@x.org"}]))
    row, listed = store.stage_index()
    store.append(records(spark, [{"id": "2", "mail": "b@x.org"}], "late"))
    store.publish(row, listed)
    assert rows(store.find({"mail": "%"}), "doc_id") == [("people:1",)]
    assert store.build_index()["mode"] == "incremental"
    assert rows(store.find({"mail": "%"}), "doc_id") == [("late:2",), ("people:1",)]


def test_a_lost_run_leaves_nothing_behind(spark, store):
    store.append(records(spark, [{"id": "1", "mail": "a@x.org"}]))
    store.stage_index()
    assert store.find({"mail": "%"}).count() == 0 and store.shard_stats.count() == 0
    first = store.build_index()
    assert (first["mode"], first["entries"], first["documents"]) == ("full", 1, 1)
    store.append(records(spark, [{"id": "2", "mail": "b@x.org"}], "more"))
    store.stage_index()
    assert rows(store.find({"mail": "%"}), "doc_id") == [("people:1",)]
    second = store.build_index()
    assert (second["mode"], second["entries"], second["files_reused"]) == ("incremental", 2, first["files_new"])
    assert rows(store.find({"mail": "%"}), "doc_id") == [("more:2",), ("people:1",)]
    assert store.build_index()["mode"] == "noop"


def test_a_changed_file_refuses_the_publication(spark, store):
    docs = documents(records(spark, [{"id": "1", "mail": "a@x.org"}]), CATALOG)
    store.append(records(spark, [{"id": "1", "mail": "a@x.org"}]))
    staged = store.stage_index()
    sinks.write_documents(docs, f"{store.root}/documents", mode="overwrite")
    with pytest.raises(RuntimeError, match="changed since"):
        store.publish(*staged)
    assert store.find({"mail": "%"}).count() == 0
    assert store.build_index()["mode"] == "full"
    late = store.stage_index()
    store.build_index()
    with pytest.raises(RuntimeError, match="another run"):
        store.publish(*late)


def test_removed_records_are_gone_after_a_full_run(spark, store):
    store.append(records(spark, [{"id": "1", "mail": "a@x.org"}, {"id": "2", "mail": "b@x.org"}]))
    store.build_index()
    shorter = documents(records(spark, [{"id": "2", "mail": "b@x.org"}]), CATALOG)
    sinks.write_documents(shorter, f"{store.root}/documents", mode="overwrite")
    store.stage_index()
    run = store.build_index()
    assert (run["mode"], run["version"], run["files_reused"], run["entries"]) == ("full", 1, 0, 1)
    assert rows(store.find({"mail": "%"}), "doc_id") == [("people:2",)]


def test_a_lost_import_is_repeated_without_copies(spark, store, tmp_path):
    store.append(records(spark, [{"id": "7", "mail": "z@x.org"}], "kept"))
    write(tmp_path / "in", "people.json", [{"id": 1, "mail": "a@x.org"}, {"id": 2}])
    write(tmp_path / "in", "kept.json", [{"id": 3}])
    store.import_folder(str(tmp_path / "in"))
    # As if the source rows had not been written: the last write of an import.
    lost = RecordStore(spark, shared_dir(spark, "lost"), CATALOG)
    for name in ("documents", "imports"):
        spark.read.parquet(f"{store.root}/{name}").write.partitionBy(
            *["source_table"] if name == "documents" else []
        ).parquet(f"{lost.root}/{name}")
    again = lost.import_folder(str(tmp_path / "in"))
    assert rows(again, "source_table", "documents_imported") == [("kept_2", 1), ("people", 2)]
    lost.build_index()
    assert rows(lost.documents, "doc_id") == [("kept:7",), ("kept_2:3",), ("people:1",), ("people:2",)]
    assert rows(lost.search({"mail": "a@x.org"}), "doc_id") == [("people:1",)]


def test_copies_with_one_number_give_one_record(spark, store):
    for _ in range(2):
        store.append(records(spark, [{"id": "1", "mail": "a@x.org"}]))
    store.build_index()
    assert rows(store.search({"mail": "a@x.org"}), "doc_id") == [("people:1",)]


def arriving(spark, folder, batch, source):
    docs = documents(records(spark, batch, source), CATALOG)
    docs.coalesce(1).write.mode("append").parquet(folder)
    return docs


def test_stream_resumes_and_matches_batch(spark):
    root = shared_dir(spark, "stream")
    docs, out, checkpoint = f"{root}/docs", f"{root}/out", f"{root}/checkpoint"
    arriving(spark, docs, [{"id": "1", "mail": "a@x.org", "number": "123456789"}], "one")
    index_new_files(spark, docs, out, checkpoint, CATALOG, max_files=1).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    arriving(spark, docs, [{"id": "2", "mail": "a@x.org"}], "two")
    arriving(spark, docs, [{"id": "3", "mail": "c@x.org"}], "three")
    index_new_files(spark, docs, out, checkpoint, CATALOG, max_files=1).awaitTermination()
    index_new_files(spark, docs, out, checkpoint, CATALOG).awaitTermination()
    columns = ["field", "shard", "term", "doc_id", "source_table", "row_id"]
    whole = postings(spark.read.parquet(docs), CATALOG)
    assert rows(spark.read.parquet(out), *columns) == rows(whole, *columns)


def test_standing_queries(spark):
    root = shared_dir(spark, "alerts")
    arriving(spark, f"{root}/docs", [{"id": "1", "mail": "a@x.org"}, {"id": "2", "mail": "b@x.org"}], "one")
    queries = spark.createDataFrame([(5, "mail", "B@X.org"), (6, "mail", "z@x.org")], "query_id bigint, field string, value string")
    stream = postings(read_document_stream(spark, f"{root}/docs"), CATALOG)
    append_stream(standing_hits(stream, queries, CATALOG), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(f"{root}/out")) == [(5, "one:2", "one")]


def test_plan_run(spark):
    files = spark.createDataFrame([("a", 1, 1)], "file_name string, size bigint, mtime bigint")
    assert plan_run(files, files).first()["mode"] == "noop"
    assert plan_run(files, files.withColumn("size", F.lit(2))).first()["mode"] == "full"
