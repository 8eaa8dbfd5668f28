import json
import random

import pyarrow.parquet as pq
import pytest
from helpers import CATALOG, RAW, one, rows
from pyspark.sql import functions as F

from fieldloom.operators import export, manifest, naming, profile, results, segments, sources
from fieldloom.operators.positions import block_of, running_totals
from fieldloom.sources import json_folder, sinks


def test_running_totals_over_many_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 11).alias("v"))
    got = running_totals(df, ["g"], ["id"], {"before": F.col("v"), "nth": F.lit(1)}, block_of(F.col("id"), 10)).collect()
    totals = {}
    for r in sorted(got, key=lambda r: r["id"]):
        before, nth = totals.get(r["g"], (0, 0))
        assert (r["before"], r["nth"]) == (before, nth)
        totals[r["g"]] = (before + r["v"], nth + 1)


@pytest.mark.parametrize(
    "text, records",
    [
        ('[{"a": 1}, {"a": 2}]', [{"a": "1"}, {"a": "2"}]),
        (' {"a": "x} {y"} ', [{"a": "x} {y"}]),
        ('{"a": 1}\n{"a": 2}\n', [{"a": "1"}, {"a": "2"}]),
        ('{"a": 1}{"a": 2} {"a": null}', [{"a": "1"}, {"a": "2"}, {"a": None}]),
        ('{"a": {"b": [1, 2]}, "a2": true}', [{"a": '{"b":[1,2]}', "a2": "true"}]),
        ("\n  ", []),
        ("[]", []),
        ("[1, 2]", None),
        ('{"a": 1', None),
        ("plain text", None),
    ],
)
def test_layouts(spark, text, records):
    parsed = json_folder.parsed_files(spark.createDataFrame([(text,)], "content string")).select("content", "_records")
    assert parsed.first()["_records"] == records


def test_repeated_key_keeps_the_last_value(spark):
    raw = F.from_json(F.lit('{"a": 1, "b": 2, "a": 3}'), RAW)
    got = spark.range(1).select(F.map_entries(json_folder.last_entry_wins(raw)).alias("e")).first()["e"]
    assert [tuple(e) for e in got] == [("a", "3"), ("b", "2")]


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "b.JSON").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "a.json").write_text('{"id": 3}{"id": 4}')
    (tmp_path / "c.txt").write_text('{"id": 5}')
    (tmp_path / "empty.json").write_text("  ")
    got = json_folder.read_records(spark, str(tmp_path))
    assert rows(got.select("file_name", "seq", F.col("raw")["id"])) == [
        ("a.json", 1, "3"), ("a.json", 2, "4"), ("b.JSON", 1, "1"), ("b.JSON", 2, "2"),
    ]
    assert rows(json_folder.file_record_counts(got)) == [("a.json", 2), ("b.JSON", 2)]
    files = json_folder.list_files(spark, str(tmp_path))
    assert rows(files, "file_name", "size") == [("a.json", 18), ("b.JSON", 22), ("empty.json", 2)]
    assert rows(json_folder.check_limits(files, max_bytes=20), "file_name", "reason") == [("b.JSON", "too large")]
    assert json_folder.check_limits(files, max_files=2, max_bytes=None).count() == 3
    assert json_folder.check_limits(files).count() == 0
    (tmp_path / "bad.json").write_text("{")
    whole = json_folder.read_whole_files(spark, str(tmp_path))
    assert rows(json_folder.unreadable(whole)) == [("bad.json",)]
    with pytest.raises(Exception, match="not readable"):
        json_folder.read_records(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    "text",
    [
        '[{"id": 1}]{"id": 2}', '[{"id": 1}][{"id": 2}]', '[{"id": 1}],[{"id": 2}]', '{"id": 1}] junk', '{"id": 1}]] junk',
        '[{"id": 1}] junk', '{"id": 1}],[{"seal": "x"}]] junk', '{"id": 1}} {"id": 2}',
    ],
)
def test_nothing_may_follow_the_first_value(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert rows(json_folder.unreadable(json_folder.read_whole_files(spark, str(tmp_path)))) == [("a.json",)]
    with pytest.raises(Exception, match="not readable"):
        json_folder.read_records(spark, str(tmp_path)).collect()


def test_a_line_is_one_object(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1},{"a": 2}\n{"a": 3}] junk\n{"a": 4}\n[{"a": 5}]\n')
    got = json_folder.read_json_lines(spark, str(tmp_path), quarantine=True)
    assert rows(got.select("seq", F.col("raw")["a"], F.col("broken").isNotNull())) == [
        (1, None, True), (2, None, True), (3, "4", False), (4, None, True),
    ]
    with pytest.raises(Exception, match="not a JSON object"):
        json_folder.read_json_lines(spark, str(tmp_path)).collect()


def test_a_file_name_must_leave_a_source_name(spark):
    files = spark.createDataFrame([(1, " .json")], "no bigint, file_name string")
    none = spark.createDataFrame([], "source_table string")
    with pytest.raises(Exception, match="no source name"):
        naming.unique_source_names(files, none, ["no"], block_of(F.col("no"), 2)).collect()


def test_sample_stats_with_nulls_and_an_outlier(spark):
    samples = [("n", None), ("n", 1.0), ("n", 2.0), ("n", 3.0), ("x", None)]
    samples += [("o", float(i % 1000)) for i in range(5000)] + [("o", 1e12)]
    got = {r["g"]: r for r in profile.sample_stats(spark.createDataFrame(samples, "g string, v double"), "g", "v").collect()}
    assert set(got) == {"n", "o"}
    assert (got["n"]["samples"], got["n"]["mean"], got["n"]["median"]) == (3, 2.0, 2.0)
    assert (got["o"]["samples"], got["o"]["median"]) == (5001, 500.0)


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    got = json_folder.read_json_lines(spark, str(tmp_path))
    assert rows(got.select("file_name", "seq", F.col("raw")["a"])) == [("x.jsonl", 1, "1"), ("x.jsonl", 2, "2")]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\nbroken\n')
    kept = json_folder.read_json_lines(spark, str(tmp_path), quarantine=True)
    assert rows(kept.where("broken is not null"), "file_name", "seq", "broken") == [("y.jsonl", 2, "broken")]
    with pytest.raises(Exception, match="not a JSON object"):
        json_folder.read_json_lines(spark, str(tmp_path)).collect()


def test_query_list(spark, tmp_path):
    (tmp_path / "q.txt").write_text("79991234567\r\n\r\n  \n7999%\n")
    got = json_folder.read_queries(spark, str(tmp_path / "q.txt"), "number")
    assert rows(got, "field", "value") == [("number", "7999%"), ("number", "79991234567")]
    assert got.select("query_id").distinct().count() == 2


def name_files(spark, names, existing):
    files = spark.createDataFrame(list(enumerate(names)), "no bigint, file_name string")
    have = spark.createDataFrame([(e,) for e in existing], "source_table string")
    got = naming.unique_source_names(files, have, ["no"], block_of(F.col("no"), 2))
    return [r["source_table"] for r in got.orderBy("no").collect()]


def test_source_names(spark):
    assert name_files(spark, ["people.json"], ["people"]) == ["people_2"]
    assert name_files(spark, ["a b.json", "a_b.x.json", ".json", "дом.json"], []) == ["a_b", "a_b.x", ".json", "_"]
    got = name_files(spark, ["p.json", "p .json", "p_2.json", "p  .json", "p_4.json", "p.json", "p.json"], ["p_6"])
    assert got == ["p", "p_3", "p_2", "p_5", "p_4", "p_7", "p_8"]
    long = name_files(spark, ["x" * 200 + ".json"], [])
    assert long == ["x" * 120]


def test_sheet_names(spark):
    titles = ["A", "A", "A_1", "A", "x" * 40, "x" * 50, "a/b:c", "a_b_c"]
    groups = spark.createDataFrame(list(enumerate(titles)), "no bigint, title string")
    got = naming.unique_sheet_names(groups, "title", ["no"], block_of(F.col("no"), 2)).orderBy("no").collect()
    names = [r["sheet_name"] for r in got]
    assert len(set(names)) == len(names) and max(map(len, names)) == 31
    assert names == ["A", "A_2", "A_1", "A_3", "x" * 31, "x" * 29 + "_1", "a_b_c", "a_b_c_1"]


FILES = "file_name string, source_table string, documents_imported bigint"
META = "file_name string, name string, description string, type string, priority bigint"


def test_new_source_rows(spark):
    files = spark.createDataFrame([("People.json", "People", 2), ("b.json", "b", 1)], FILES)
    meta = spark.createDataFrame([(" PEOPLE.JSON ", "Named", " ", "kind", 0)], META)
    got = rows(sources.new_source_rows(files, meta, default_name="All"), "source_table", "name", "description", "type")
    assert got == [
        ("People", "Named", "Imported from file People.json", "kind"),
        ("b", "All (b)", "Imported from file b.json", "local-import"),
    ]
    single = sources.new_source_rows(files.where("source_table = 'b'"), meta, "All", "Text", "t")
    assert rows(single, "name", "description", "type") == [("All", "Text", "t")]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "kept")], "source_table string, name string")
    new = spark.createDataFrame([("a", "new", 0), ("a", "newest", 1), ("c", "added", 0)], "source_table string, name string, priority int")
    assert rows(sources.upsert_sources(old, new)) == [("a", "newest"), ("b", "kept"), ("c", "added")]


def test_catalogue(spark):
    raw = spark.createDataFrame(
        [
            ("s1", "f.json", "Ünit", "telecom list", "phones", 10_871_294, "2024-03-01", "KZ", 2, 5, {"mail": False}),
            ("s2", None, "", None, None, None, None, None, None, None, None),
            ("s3", "g.json", "alpha", None, None, 7, "01.02.2024", None, None, None, {}),
        ],
        "source_table string, file_name string, name string, description string, type string, documents_imported bigint, "
        "imported_at string, country string, access_level int, trust int, search_fields map<string,boolean>",
    )
    cat = sources.catalog_rows(raw, ["mail", "number"]).cache()
    first, second, third = (r.asDict() for r in cat.orderBy("name_table").collect())
    assert first["count"] == "10871294" and first["search_mail"] == "false" and first["search_number"] == "true"
    assert first["access_level"] == "2" and first["trust"] == "5" and first["updated_at"] == "2024-03-01"
    assert second == {
        "name_table": "s2", "name": "s2", "info": "Local source", "country": "", "access_level": "local", "count": "0",
        "search_mail": "true", "search_number": "true", "type": "local-import", "trust": "true",
        "updated_at": "", "created_at": "", "relevance_date": "",
    }
    assert third["info"] == "Import from file g.json"
    assert sources.catalog_totals(cat).first().asDict() == {"rows": 3, "records": 10_871_301}
    assert rows(sources.catalog_types(raw)) == [("phones",), ("unknown",)]
    assert rows(sources.filter_type(raw, "unknown"), "source_table") == [("s2",), ("s3",)]
    assert sources.filter_type(raw, None).count() == 3
    by_count = [r["name_table"] for r in sources.sort_rows(cat, "count", descending=True).collect()]
    assert by_count == ["s1", "s3", "s2"]
    by_name = [r["name"] for r in sources.sort_rows(cat, "name").collect()]
    assert by_name == ["alpha", "s2", "Ünit"]
    dated = sources.timeline_rows(cat)
    assert rows(dated, "year", "month", "day", "name", "count") == [
        (2024, 2, 1, "alpha", "7"), (2024, 3, 1, "Ünit", "10,871,294"),
    ]
    assert rows(sources.timeline_months(dated), "year", "month", "sources", "records") == [(2024, 2, 1, 7), (2024, 3, 1, 10_871_294)]


MANIFEST = "file_name string, size bigint, mtime bigint"


@pytest.mark.parametrize(
    "now, mode",
    [
        ([("a", 1, 1), ("b", 2, 2)], "noop"),
        ([("a", 1, 1), ("b", 2, 2), ("c", 1, 1)], "incremental"),
        ([("a", 1, 1), ("b", 3, 2)], "full"),
        ([("a", 1, 1), ("b", 2, 3), ("c", 1, 1)], "full"),
        ([("a", 1, 1)], "full"),
    ],
)
def test_build_mode(spark, now, mode):
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], MANIFEST)
    current = spark.createDataFrame(now, MANIFEST)
    assert manifest.build_mode(manifest.manifest_diff(before, current)).first()["mode"] == mode
    allowed = manifest.may_promote(before, current, before.select("file_name")).first()["allowed"]
    assert allowed is (mode == "noop")


def test_first_build_is_full_and_missing_results_stop_promotion(spark):
    none = spark.createDataFrame([], MANIFEST)
    one_file = spark.createDataFrame([("a", 1, 1)], MANIFEST)
    assert manifest.build_mode(manifest.manifest_diff(none, one_file)).first()["mode"] == "full"
    assert manifest.build_mode(manifest.manifest_diff(none, none)).first()["mode"] == "noop"
    check = manifest.may_promote(one_file, one_file, none.select("file_name")).first()
    assert (check["allowed"], check["moved"], check["missing"]) == (False, 0, 1)


def test_segments(spark):
    sizes = [50, 60, 70, 500, 90, 10, 10, 10, 160, 40, 300, 20]
    lines = spark.createDataFrame([("f", i, "x" * (n - 1)) for i, n in enumerate(sizes)], "file_name string, seq bigint, line string")
    offsets = [r["byte_offset"] for r in segments.byte_offsets(lines).orderBy("seq").collect()]
    assert offsets == [sum(sizes[:i]) for i in range(len(sizes))]
    got = segments.segment_plan(lines, limit=300).orderBy("seq").collect()
    assert len(got) == len(sizes)
    numbers = [r["segment"] for r in got]
    assert numbers == sorted(numbers) and set(numbers) == set(range(1, max(numbers) + 1))
    for number in set(numbers):
        inside = [r["bytes"] for r in got if r["segment"] == number]
        assert sum(inside) <= 300 or len(inside) == 1
    assert one(spark, "a_part_0003.jsonl", lambda v: segments.segment_names(v, F.lit(12))) == "a_part_0003_part_0012.jsonl"


def test_segment_sink(spark, tmp_path):
    lines = spark.createDataFrame([("f.jsonl", i, f'{{"n":{i}}}') for i in range(6)], "file_name string, seq bigint, line string")
    plan = segments.segment_plan(lines, limit=20).select("file_name", "seq", "segment")
    sinks.write_segments(lines.join(plan, ["file_name", "seq"]), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == 6 and back.select("segment").distinct().count() > 1


def test_profiles(spark):
    shards = spark.createDataFrame(
        [("a", "x", 5, 10), ("a", "y", 5, 20), ("a", "z", 1, 99), ("b", "x", 0, 7)], "field string, shard string, n bigint, bytes bigint"
    )
    got = rows(profile.shard_profile(shards), "field", "shards", "entries", "mean_entries", "size", "largest_shard")
    assert got == [("a", 3, 11, 4, "129 B", "y"), ("b", 1, 0, 0, "7 B", "x")]
    assert [r["shard"] for r in profile.hot_shards(shards, 2).collect()] == ["y", "x"]
    joined = profile.shards_with_sizes(shards.where("n > 1").select("field", "shard", "n"), shards.select("field", "shard", "bytes"))
    assert rows(joined.where("field = 'b'")) == [("b", "x", 0, 7)]
    dup = spark.createDataFrame([("d:1",), ("d:1",), ("d:2",)], "doc_id string")
    assert rows(profile.duplicate_ids(dup)) == [("d:1", 2)]
    samples = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 1.0, 2.0)] + [("b", 3.0)], "g string, v double")
    assert rows(profile.sample_stats(samples, "g", "v")) == [("a", 4, 1.0, 5.0, 2.25, 1.5), ("b", 1, 3.0, 3.0, 3.0, 3.0)]


def test_exports(spark, tmp_path):
    data = [("s", 1, '{"a": "x,y", "b": "2"}'), ("s", 2, '{"c": "q\\"r", "a": "1"}'), ("t", 1, '{"z": "9"}')]
    recs = spark.createDataFrame(data, "source_table string, seq bigint, text string").select(
        "source_table", "seq", F.from_json("text", RAW).alias("fields")
    )
    headers = spark.createDataFrame([("s", "Name", "Info, more")], "source_table string, name string, info string")
    lines = export.csv_lines(recs, headers)
    got = [r["line"] for r in lines.orderBy("source_table", "part", "seq").collect()]
    assert got == ["Source: Name", '"Info, more"', "a,b,c", '"x,y",2,', '1,,"q""r"']
    text = [r["line"] for r in export.text_lines(recs, headers).orderBy("part", "seq").collect()]
    assert text == ["Source: Name", "Info, more", "a = x,y\nb = 2\n", 'c = q"r\na = 1\n']
    sinks.write_lines(lines, str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv" / "source_table=s").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == got


def test_catalog_rejects_bad_specs():
    from fieldloom.catalog import Catalog, FieldSpec

    with pytest.raises(ValueError):
        FieldSpec("x", "unheard")
    with pytest.raises(ValueError):
        FieldSpec("x", "digits_exact")
    with pytest.raises(ValueError):
        Catalog((FieldSpec("x", "text"), FieldSpec("x", "code")))
    assert [s.name for s in CATALOG.only(["mail"])] == ["mail"]


def test_segments_are_packed_until_full(spark):
    """Lines of every size, several files: the same as going through them one by one."""
    rng = random.Random(8)
    files = {
        "small": [rng.randrange(1, 20) for _ in range(400)],
        "mixed": [rng.choice([1, 5, 40, 99, 100, 101, 350]) for _ in range(200)],
        "exact": [25] * 40,
        "large": [500, 700, 900],
        "one": [7],
    }
    limit, want = 100, {}
    for name, sizes in files.items():
        segment, used = 1, 0
        for i, size in enumerate(sizes):
            if used and used + size > limit:
                segment, used = segment + 1, 0
            used += size
            want[name, i * 3] = segment
    lines = [(n, i * 3, "é" * ((s - 1) // 2) + "x" * ((s - 1) % 2)) for n, sizes in files.items() for i, s in enumerate(sizes)]
    given = spark.createDataFrame(lines, "file_name string, seq bigint, line string").repartition(3)
    got = segments.segment_plan(given, limit=limit).collect()
    assert {(r["file_name"], r["seq"]): r["segment"] for r in got} == want and len(got) == len(want)
    inside = {}
    for r in got:
        inside[r["file_name"], r["segment"]] = inside.get((r["file_name"], r["segment"]), 0) + r["bytes"]
    assert all(r["segment_bytes"] == inside[r["file_name"], r["segment"]] for r in got)
    assert segments.segment_plan(given.limit(0)).count() == 0


def test_large_line_files_are_read_in_splits(spark, tmp_path):
    """Every layout, once in files of one split and once in files of many."""
    folder = tmp_path / "in"
    folder.mkdir()
    records = [{"id": str(i), "note": f"a}} {{b {i}"} for i in range(300)]
    plain = [{"id": str(i), "note": f"n{i}"} for i in range(300)]
    layouts = {
        "lines.json": (records, "\n\n".join(json.dumps(r) for r in records)),
        "array.json": (records, json.dumps(records, indent=1)),
        "spread.json": (plain, "\n".join(json.dumps(r, indent=1) for r in plain)),
        "joined.json": (plain, "".join(json.dumps(r) for r in plain)),
        "mixed.json": (plain, json.dumps(plain[0]) + "\n" + "\n".join(json.dumps(r, indent=1) for r in plain[1:])),
        "small.json": (records[:2], "\n".join(json.dumps(r) for r in records[:2])),
        "blank.json": ([], " \n" * 2000),
    }
    for name, (_, text) in layouts.items():
        (folder / name).write_text(text, encoding="utf8")
    want = sorted((n, i, r["id"], r["note"]) for n, (rs, _) in layouts.items() for i, r in enumerate(rs, 1))
    named = spark.createDataFrame([(n, n[:-5]) for n in layouts if n != "joined.json"], "file_name string, source_table string")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = json_folder.read_records(spark, str(folder))
        assert rows(found, "file_name", "seq", F.col("raw")["id"], F.col("raw")["note"]) == want
        tasks = json_folder.read_json_lines(spark, str(folder), glob="lines.json").select(F.spark_partition_id()).distinct()
        assert tasks.count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    some = json_folder.read_records(spark, str(folder), named=named, split_bytes=1000)
    assert rows(some, "source_table", "seq", F.col("raw")["id"]) == sorted((n[:-5], i, d) for n, i, d, _ in want if n != "joined.json")


def test_export_files_are_framed(spark, tmp_path):
    data = [("s", 1, '{"a": "1"}'), ("s", 2, '{"b": "2"}'), ("x", 1, '{"z": "9"}')]
    recs = spark.createDataFrame(data, "source_table string, seq bigint, text string").select(
        "source_table", "seq", F.from_json("text", RAW).alias("fields")
    )
    heads = [("r", "None", "Nothing met"), ("s", "Name", ""), ("t", "Last", None)]
    headers = spark.createDataFrame(heads, "source_table string, name string, info string")

    def file_of(lines, name):
        sinks.write_document(lines, str(tmp_path / name))
        return "".join(p.read_text(encoding="utf8") for p in sorted((tmp_path / name).glob("part-*")))

    csv = file_of(export.csv_document(recs, headers), "csv")
    assert csv == '﻿Source: None\nNothing met\n\n"No data"\n\nSource: Name\n\na,b\n1,\n,2\n\nSource: Last\n\n"No data"\n'
    text = file_of(export.text_document(recs, headers), "text")
    rule = "-----------------------\n\n"
    assert text == (
        f"Source: None\nNothing met\n\nNo data\n\n{rule}Source: Name\n\na = 1\n\nb = 2\n\n{rule}Source: Last\n\nNo data\n\n"
    )
    assert export.csv_document(recs, headers.limit(0)).count() == 0


def test_a_chunk_is_read_without_those_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROW_GROUP_BYTES", 1 << 16)
    stream = spark.range(30_000).select(F.col("id").alias("position"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    sinks.write_stream_rows(stream.repartition(5), str(tmp_path / "stream"))
    stored = spark.read.parquet(str(tmp_path / "stream"))
    page = results.chunk_after(stored, 29_799)
    assert [r["position"] for r in page.collect()] == list(range(29_800, 30_000))
    assert [r["position"] for r in results.chunk_after(stored, -1, 3).collect()] == [0, 1, 2]
    assert "GreaterThan(position,29799)" in page._jdf.queryExecution().toString()
    groups = [
        (g.column(0).statistics.min, g.column(0).statistics.max)
        for file in (tmp_path / "stream").glob("part-*.parquet")
        for meta in [pq.ParquetFile(file).metadata]
        for g in map(meta.row_group, range(meta.num_row_groups))
    ]
    assert len(groups) > 5 and sum(low <= 29_999 and high > 29_799 for low, high in groups) <= 2
