import json

import pytest
from helpers import CATALOG, RAW, records, rows
from pyspark.sql import functions as F

from fieldloom.operators import batch, results, search
from fieldloom.operators.postings import postings, record_postings
from fieldloom.operators.records import documents


@pytest.fixture(scope="module")
def people(spark):
    raw = [
        {"id": "10", "number": "+7 (999) 123-45-67", "mail": "Ann@X.org", "name": "Ann", "surname": "Lee", "note": " hi "},
        {"id": None, "number": "79991230000", "full_name": "Александра Белова", "name": "dropped", "day": "2020-02-01"},
        {"id": "0", "number": "79274279737 8434125131 79274279747", "plate": "a 1_b", "note_id": "n1"},
        {"id": "", "full_name": "Single", "mail": "broken", "code10": "12345678901", "blank": "  ", "empty": ""},
        {"full_name": "Алексей Белов", "number": "   ", "account": "77"},
    ]
    return records(spark, raw).cache()


@pytest.fixture(scope="module")
def docs(people):
    return documents(people, CATALOG).cache()


@pytest.fixture(scope="module")
def index(docs):
    return postings(docs, CATALOG).cache()


def test_documents(docs):
    found = {r["seq"]: r for r in docs.collect()}
    assert [found[i]["doc_id"] for i in range(1, 6)] == ["people:10", "people:2", "people:0", "people:", "people:5"]
    assert found[1]["fields"] == {
        "id": "10", "number": "79991234567", "mail": "ann@x.org", "note": "hi", "full_name": "LEE ANN",
    }
    keys = docs.where("seq = 1").select(F.map_keys("fields")).first()[0]
    assert keys == ["id", "number", "mail", "note", "full_name"]
    assert found[2]["fields"] == {"number": "79991230000", "full_name": "АЛЕКСАНДРА БЕЛОВА", "day": "01.02.2020"}
    assert found[3]["invalid_fields"] == {"no_valid_number": "79274279737 8434125131 79274279747"}
    assert found[4]["fields"] == {"blank": ""}
    assert found[4]["invalid_fields"] == {
        "no_valid_full_name": "Single", "no_valid_mail": "broken", "no_valid_code10": "12345678901",
    }
    assert "number" not in found[5]["fields"] and found[5]["invalid_fields"] == {}
    assert json.loads(found[1]["raw"])["name"] == "Ann"


def test_postings(index):
    got = set(rows(index, "field", "term", "row_id"))
    assert {t for f, t, r in got if r == "0" and f == "number"} == {"79274279737", "8434125131", "79274279747"}
    assert ("full_name", "SINGLE", "") in got
    assert ("code10", "12345678901", "") in got
    assert ("plate", "A1_B", "0") in got
    assert not [t for f, t, r in got if f == "note_id"]
    assert len(got) == index.count()


def test_both_posting_paths_agree(people, index):
    direct = record_postings(people, CATALOG)
    assert rows(direct) == rows(index)


def test_a_term_on_both_sides_is_posted_once(spark):
    df = spark.createDataFrame(
        [("d:1", "d", "1", {"mail": "a@b.c", "number": "123456789"}, {"no_valid_mail": "A@b.c", "no_valid_number": "123456789 987654321"})],
        f"doc_id string, source_table string, row_id string, fields {RAW}, invalid_fields {RAW}",
    )
    assert rows(postings(df, CATALOG), "field", "term") == [("mail", "a@b.c"), ("number", "123456789"), ("number", "987654321")]


def ids(index, query, **options):
    return {r["doc_id"] for r in search.search(index, query, CATALOG, **options).collect()}


@pytest.mark.parametrize(
    "query, expected",
    [
        ({"number": "+7 (999) 123-45-67"}, {"people:10"}),
        ({"number": "7999%"}, {"people:10", "people:2"}),
        ({"number": "7999123????"}, {"people:10", "people:2"}),
        ({"number": "7999123?"}, set()),
        ({"number": "7999%", "mail": "ann@x.ORG"}, {"people:10"}),
        ({"number": "7999%", "mail": "none@x.org"}, set()),
        ({"full_name": "АЛЕКС%"}, {"people:2", "people:5"}),
        ({"full_name": "алекс бел"}, {"people:2", "people:5"}),
        ({"full_name": "бел алекс"}, set()),
        ({"plate": "A1_%"}, {"people:0"}),
        ({"plate": "A_1B"}, set()),
        ({"mail": "broken"}, {"people:"}),
        ({"number": "none", "mail": "broken"}, {"people:"}),
        ({"note_id": "n1"}, set()),
        ({"colour": "red"}, set()),
        ({"mail": None, "number": ""}, set()),
    ],
)
def test_search(index, query, expected):
    assert ids(index, query) == expected


def test_strict_search_does_not_widen(index):
    assert ids(index, {"number": "none", "mail": "broken"}, strict=True) == set()
    assert ids(index, {"unknown": "x", "mail": "ann@x.org"}, strict=True) == set()


def test_narrowest_first_gives_the_same_ids(spark, index):
    from fieldloom.operators.profile import shard_stats

    stats = shard_stats(index)
    query = {"number": "79991234567", "mail": "ann@x.org", "full_name": "LEE%"}
    assert ids(index, query, shard_stats=stats) == {"people:10"}
    terms = search.resolve(spark, query, CATALOG)
    plan = search.matching_ids(index, terms, stats)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    # Without counts nothing is known to be narrow, and nothing is broadcast by hint.
    assert ids(index, query, shard_stats=stats.limit(0)) == {"people:10"}
    assert "broadcast" not in plan.lower()


def test_prefix_bounds_reach_the_scan(spark, index, tmp_path):
    index.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found = search.search(stored, {"number": "79?9%"}, CATALOG)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,79)" in plan and "LessThan(term,7:)" in plan
    assert found.count() == 2


def test_everything_wildcard_equals_all_postings(index):
    every = {r["doc_id"] for r in index.where("field = 'number'").collect()}
    assert ids(index, {"number": "%"}) == every


def test_batch_equals_single_searches(spark, index):
    asked = [
        ("number", "79991234567"), ("number", "7999%"), ("number", "%0000"), ("number", "?9991*23%"), ("mail", "ANN@x.org"),
        ("full_name", "алекс"), ("full_name", "%"), ("plate", "a?_b"), ("number", "none"), ("colour", "red"), ("mail", "ann@x.org"),
    ]
    queries = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(asked)], "query_id bigint, field string, value string")
    got = {}
    for row in batch.batch_search(index, queries, CATALOG).collect():
        got.setdefault(row["query_id"], []).append(row["doc_id"])
    for i, (field, value) in enumerate(asked):
        found = got.get(i, [])
        assert len(found) == len(set(found))
        assert set(found) == ids(index, {field: value}), (field, value)


def test_a_hot_term_is_spread(spark):
    """A third of all postings under one term: no join key holds them all."""
    hot = spark.range(3000).select(
        F.lit("number").alias("field"),
        F.when(F.col("id") < 1000, "70000000000").otherwise(F.col("id").cast("string")).alias("term"),
        F.concat(F.lit("d:"), F.col("id").cast("string")).alias("doc_id"),
        F.lit("d").alias("source_table"),
    )
    queries = spark.createDataFrame([(1, "number", "70000000000"), (2, "number", "2999"), (3, "number", "7000%")], "query_id bigint, field string, value string")
    hits = batch.batch_search(hot, queries, CATALOG)
    assert {r["query_id"]: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 1000, 2: 1, 3: 1000}
    share = hot.where("term = '70000000000'").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(batch.SALTS))).count()
    assert share.agg(F.max("count")).first()[0] < 150


def test_first_duplicate_wins(spark):
    raw = [{"id": "1", "mail": "a@b.c", "note": "first"}, {"id": "1", "mail": "a@b.c", "note": "second"}]
    docs = documents(records(spark, raw), CATALOG)
    found = search.search(postings(docs, CATALOG), {"mail": "a@b.c"}, CATALOG)
    got = results.fetch(docs, found).collect()
    assert [r["fields"]["note"] for r in got] == ["first"]
    assert [r["fields"]["note"] for r in results.first_of_each(docs).collect()] == ["first"]


SOURCE_COLUMNS = "source_table string, file_name string, name string, description string, type string"


def test_stream_is_complete_ordered_and_chunked(spark):
    raw = [{"id": str(i), "mail": "one@x.org"} for i in range(1, 321)]
    docs = documents(records(spark, raw), CATALOG)
    found = results.result_records(results.fetch(docs, search.search(postings(docs, CATALOG), {"mail": "one@x.org"}, CATALOG)))
    sources = spark.createDataFrame([], SOURCE_COLUMNS)
    stream = results.result_stream(found, sources)
    chunks = list(results.iterate_chunks(stream))
    assert [len(c) for c in chunks] == [200, 121]
    items = [r for c in chunks for r in c]
    assert [r["position"] for r in items] == list(range(321))
    assert items[0]["kind"] == "header" and items[0]["body"] == "people | Local source | local-import"
    assert [r["doc_id"] for r in items[1:]] == [f"people:{i}" for i in range(1, 321)]
    assert results.result_totals(found).first().asDict() == {
        "total_results": 321, "matched_documents": 320, "matched_sources": 1,
    }
    split = results.split_kinds(stream)
    assert split["header"].count() == 1 and split["record"].count() == 320 and split["unknown"].count() == 0


def test_headers_fall_back(spark):
    recs = spark.createDataFrame([("a",), ("b",), ("c",)], "source_table string")
    sources = spark.createDataFrame(
        [("a", "a.json", "A", "text", "kind"), ("b", "b.json", "", None, None)], SOURCE_COLUMNS
    )
    got = rows(results.result_headers(recs, sources), "source_table", "name", "info", "type", "records")
    assert got == [
        ("a", "A", "text", "kind", 1),
        ("b", "b", "Import from file b.json", "local-import", 1),
        ("c", "c", "Local source", "local-import", 1),
    ]


def test_invalid_values_are_shown_and_suggested(docs, index):
    found = results.result_records(results.fetch(docs, search.search(index, {"number": "7999%"}, CATALOG)))
    got = results.suggestions(found, {"mail": "ann@x.org"}, CATALOG).collect()
    assert [(r["field"], r["value"]) for r in got] == [
        ("number", "79991234567"), ("full_name", "LEE ANN"),
        ("number", "79991230000"), ("full_name", "АЛЕКСАНДРА БЕЛОВА"), ("day", "01.02.2020"),
    ]
    facets = rows(results.facet_counts(found).where("key = 'number'"), "value", "n")
    assert facets == [("79991230000", 1), ("79991234567", 1)]
