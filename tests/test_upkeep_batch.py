"""Index upkeep by parts, search during a build, batch queries of several lines."""

import itertools
import random
import re

import pytest
from helpers import CATALOG, records, rows
from pyspark.sql import functions as F

from fieldloom.operators import batch, export, profile, results
from fieldloom.operators.postings import postings
from fieldloom.operators.records import documents
from fieldloom.session import shared_dir
from fieldloom.sources import json_folder, sinks
from fieldloom.store import RecordStore, SupersededError, file_path

COLUMNS = ["field", "shard", "term", "doc_id", "source_table", "row_id"]
QUERIES = "query_id bigint, field string, value string"


@pytest.fixture
def store(spark):
    return RecordStore(spark, shared_dir(spark, "store"), CATALOG)


def people(store, source, *mails):
    made = [{"id": str(i), "mail": m, "number": f"79990000{i:03}"} for i, m in enumerate(mails, 1)]
    store.append(records(store.spark, made, source).coalesce(1))


def check(store):
    """The index holds what a fresh one would, and its kept counts are right."""
    assert rows(store.postings, *COLUMNS) == rows(postings(store.documents, CATALOG), *COLUMNS)
    counted = profile.shard_stats(store.postings)
    assert rows(store.shard_stats, "field", "shard", "n") == rows(counted, "field", "shard", "n")
    last = store._last_run()
    assert last["entries"] == store.postings.count() and last["documents"] == store.documents.count()
    assert {(r["field"], r["term"]) for r in store.postings.collect()} <= {(r["field"], r["term"]) for r in store.terms.collect()}


def part_rows(store, row):
    """How many postings each part of a run holds on disk."""
    return [store.spark.read.parquet(f"{store.root}/postings/part={p['part']}").count() for p in row["parts"]]


def test_replaced_and_removed_files_leave_the_other_parts_alone(spark, store):
    for source in ("a", "b", "c"):
        people(store, source, f"{source}@x.org", "same@x.org")
    first = store.build_index()
    people(store, "d", "d@x.org")
    second = store.build_index()
    assert second["mode"] == "incremental" and second["parts"][0] == first["parts"][0]
    check(store)
    changed = documents(records(spark, [{"id": "1", "mail": "new@x.org"}], "b"), CATALOG)
    sinks.replace_sources(changed, f"{store.root}/documents")
    run = store.build_index(on_change="replace")
    assert run["mode"] == "replace" and run["version"] == second["version"]
    assert run["parts"][:2] == second["parts"] and part_rows(store, run) == [12, 2, 1]
    assert rows(store.find({"mail": "%"}), "doc_id") == [("a:1",), ("a:2",), ("b:1",), ("c:1",), ("c:2",), ("d:1",)]
    assert store.find({"mail": "b@x.org"}).count() == 0
    check(store)
    # A file that is gone, and its name taken up again later.
    kept = store.documents.where("source_table <> 'd'")
    other = RecordStore(spark, shared_dir(spark, "other"), CATALOG)
    sinks.write_documents(kept, f"{other.root}/documents")
    other.build_index()
    assert rows(other.find({"mail": "%"}), "doc_id") == [("a:1",), ("a:2",), ("b:1",), ("c:1",), ("c:2",)]
    assert store.build_index(on_change="replace")["mode"] == "noop"
    assert store.merge_parts(fan=2)["mode"] == "merge"
    merged = store._last_run()
    assert part_rows(store, merged) == [merged["entries"]] and merged["dead"] is None
    check(store)
    assert store.build_index()["mode"] == "noop"


def test_a_removed_file_stays_gone_through_merges(spark, store, tmp_path):
    for source in ("a", "b"):
        people(store, source, f"{source}@x.org")
        store.build_index()
    for file in [r["file_name"] for r in store.document_files().collect() if "source_table=a" in r["file_name"]]:
        path = re.sub(r"^file:/+", "/", file)
        spark.read.parquet(path).write.parquet(str(tmp_path / "kept"))
        jvm = spark._jvm.java.io.File(path)
        assert jvm.delete()
    people(store, "c", "c@x.org")
    run = store.build_index(on_change="replace", fan=9)
    assert (run["mode"], run["files_new"], run["documents"]) == ("replace", 1, 2)
    check(store)
    people(store, "d", "d@x.org")
    store.build_index(fan=9)
    # Only the two newest parts are merged: what is gone from the first must stay known.
    last = store._last_run()
    store._write_run(store._merge(last, 2))
    check(store)
    people(store, "a", "again@x.org")
    assert store.build_index(fan=9)["mode"] == "incremental"
    check(store)


def test_many_small_runs_are_merged(spark, store):
    for i in range(9):
        people(store, f"s{i}", f"m{i}@x.org")
        assert store.build_index(fan=3)["mode"] in ("full", "incremental")
    assert len(store._last_run()["parts"]) <= 2 * 3
    assert store.find({"mail": "m%"}).count() == 9
    check(store)
    assert store.build_index()["mode"] == "noop"


def test_a_run_number_is_taken_once(spark, store):
    people(store, "a", "a@x.org")
    one, other = store.stage_index(), store.stage_index()
    store.publish(*one)
    with pytest.raises(SupersededError):
        store.publish(*other)
    check(store)


def test_search_between_two_batches(spark, store):
    checkpoint = shared_dir(spark, "checkpoint")
    seen = []
    merge = store.merge_parts

    def look(fan):
        seen.append(store.find({"mail": "same@x.org"}).count())
        return merge(fan)

    store.merge_parts = look
    for source in ("a", "b", "c"):
        people(store, source, "same@x.org")
    store.index_stream(checkpoint, max_files=1).awaitTermination()
    assert seen == [1, 2, 3]
    check(store)
    people(store, "d", "same@x.org")
    assert store.find({"mail": "same@x.org"}).count() == 3
    store.index_stream(checkpoint, max_files=1).awaitTermination()
    assert seen[3:] == [4]
    assert store.build_index()["mode"] == "noop"
    check(store)


def test_a_replayed_batch_changes_nothing(spark, store):
    people(store, "a", "a@x.org")
    given = store.documents.withColumns(
        {"_file": file_path(), "_size": F.col("_metadata.file_size"), "_mtime": F.col("_metadata.file_modification_time")}
    )
    first = store.index_batch(given, "stream", 0)
    assert (first["mode"], first["entries"]) == ("full", 2)
    assert store.index_batch(given, "stream", 0) is None
    # Under another number the file is known already: an empty part.
    assert store.index_batch(given, "stream", 1)["entries"] == 2
    check(store)


def test_a_batch_that_was_not_published_is_never_read(spark, store):
    people(store, "a", "a@x.org")
    store.build_index()
    people(store, "b", "b@x.org")
    given = store.documents.withColumns(
        {"_file": file_path(), "_size": F.col("_metadata.file_size"), "_mtime": F.col("_metadata.file_modification_time")}
    )
    write, store._write_run = store._write_run, lambda row: None
    store.index_batch(given, "stream", 0)
    store._write_run = write
    assert rows(store.find({"mail": "%"}), "doc_id") == [("a:1",)]
    store.index_batch(given, "stream", 0)
    check(store)


def test_store_batch_of_lines(spark, store):
    people(store, "a", "x@a.org", "y@a.org")
    people(store, "b", "x@b.org", "y@a.org")
    store.build_index()
    asked = [
        (1, "mail", "y@%"), (1, "number", "79990000002"),
        (2, "mail", "%@b.org"), (2, "number", "7999%"),
        (3, "mail", "%@b.org"), (3, "number", "1%"),
        (4, "mail", "x%"), (4, "mail", "%@A.org"), (4, "number", " "), (4, "colour", "red"),
        (5, "mail", "z@a.org"), (6, "number", ""), (7, "mail", "?@?????"), (7, "mail", "?@?????"),
    ]
    queries = spark.createDataFrame(asked, QUERIES)
    want = [(1, "a:2"), (1, "b:2"), (2, "b:1"), (4, "a:1"), (7, "a:1"), (7, "a:2"), (7, "b:1"), (7, "b:2")]
    assert rows(store.batch_and(queries), "query_id", "doc_id") == want
    found = store.batch_records(queries)
    assert rows(found, "query_id", "doc_id") == want
    assert {r["fields"]["mail"] for r in found.collect() if r["query_id"] == 2} == {"x@b.org"}
    headers = results.result_headers(found, store.sources, by=("query_id",))
    assert rows(headers, "query_id", "source_table", "records")[:3] == [(1, "a", 1), (1, "b", 1), (2, "b", 1)]
    lines = export.csv_lines(found, headers, by=("query_id",)).where("query_id = 2").orderBy("part", "seq")
    assert [r["line"] for r in lines.collect()] == ["Source: b", "Local source", "id,mail,number", "1,x@b.org,79990000001"]
    assert store.batch_and(queries.limit(0)).count() == 0
    folder = store.store_results({"mail": "%@a.org"})
    first = store.result_page(folder, items=3).collect()
    assert [(r["position"], r["kind"], r["source_table"]) for r in first] == [(0, "header", "a"), (1, "record", "a"), (2, "record", "a")]
    assert [r["doc_id"] for r in store.result_page(folder, after=2, items=3).collect()] == [None, "b:2"]


def test_lines_match_single_searches(spark):
    """Random queries of one to three lines against sets worked out per document."""
    rng = random.Random(2)
    made = [{"id": str(i), "mail": f"{rng.choice('ab')}{rng.choice('cd')}@x.org", "account": str(rng.randrange(12)), "plate": rng.choice("PQ")} for i in range(60)]
    made += [dict(made[0]), dict(made[1], account="5")]
    found = postings(documents(records(spark, made), CATALOG), CATALOG)
    values = {"mail": ["ac@x.org", "a%", "%d@x.org", "%c@%", "zz%"], "account": ["1", "1%", "?", "%1%", "%"], "plate": ["P", "?", "Q"]}
    asked = [(q, f, rng.choice(values[f])) for q in range(40) for f in rng.choices(list(values), k=rng.randrange(1, 4))]
    terms = {}
    for r in found.collect():
        terms.setdefault(r["doc_id"], set()).add((r["field"], r["term"]))

    def meets(doc, field, value):
        pattern = re.escape(value).replace("%", ".*").replace(r"\?", ".")
        return any(f == field and re.fullmatch(pattern, t) for f, t in terms[doc])

    want = sorted(
        (q, doc)
        for q, lines in itertools.groupby(asked, key=lambda a: a[0])
        for lines in [list(lines)]
        for doc in terms
        if all(meets(doc, f, v) for _, f, v in lines)
    )
    got = batch.batch_and(found, spark.createDataFrame(asked, QUERIES), CATALOG)
    assert rows(got, "query_id", "doc_id") == want


def test_query_list_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" a@x.org \r\n\r\n\tb@x.org\n", encoding="utf8")
    listed = json_folder.read_queries(spark, str(tmp_path / "list.txt"), "mail")
    assert [r["field"] for r in listed.collect()] == ["mail", "mail"]
    found = postings(documents(records(spark, [{"id": "1", "mail": "b@x.org"}]), CATALOG), CATALOG)
    assert rows(batch.batch_and(found, listed, CATALOG), "doc_id") == [("people:1",)]


PATTERNS = ["%", "?", "??%", "%?", "???", "%b%", "%ab%", "?ab?", "%abc%", "%a%bcd?%", "%d", "?cd", "%bcda", "a%", "abcdabcd%", "%abcdabcda", "ab?d%a"]


def test_patterns_match_by_pieces_of_text(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcd", k=rng.randrange(1, 14))) for _ in range(300)} | {"a", "😀b", "a😀cd"}
    terms = spark.createDataFrame(
        [(i, "mail", p, True) for i, p in enumerate(PATTERNS)], "query_id bigint, field string, term string, wildcard boolean"
    )
    listed = spark.createDataFrame([("mail", w) for w in words], "field string, term string")
    got = rows(batch.matched_terms(terms, listed), "query_id", "term")
    want = [(i, w) for i, p in enumerate(PATTERNS) for w in words if re.fullmatch(p.replace("%", ".*").replace("?", "."), w)]
    assert got == sorted(want)


def test_no_pattern_meets_every_term(spark):
    """A pattern without a beginning is joined on its end, on what stands inside, or on lengths."""
    patterns = spark.createDataFrame([("m", p) for p in PATTERNS], "field string, term string")
    keys = batch.pattern_keys(patterns).collect()
    assert all(r["key"] for r in keys)
    kinds = {r["term"]: r["kind"] for r in keys}
    assert kinds["%abc%"] == "gram3" and kinds["%bcda"] == "tail4" and kinds["???"] == "length" and kinds["ab?d%a"] == "head2"
    assert [r["key"] for r in keys if r["term"] == "???"] == ["1"]
    words = spark.createDataFrame([("m", f"{i:06}") for i in range(500)] + [("m", "12xyz34")], "field string, term string")
    pieces = batch.word_keys(words, ["gram3"])
    assert pieces.where("key = 'xyz'").count() == 1
