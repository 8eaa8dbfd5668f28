"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from fieldloom.llm.oracle import ORACLE
from fieldloom.llm.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents conversations embeddings labels benchmark".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = REGISTRY[name](spark, SF_DIR)
    columns = sorted(df.columns)
    answer = con.sql(ORACLE[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in places)) for r in answer.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in REGISTRY) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert docs.filter("text rlike '<(EMAIL|IP|CARD|PHONE)>'").count() > 0
    assert docs.filter("n_chars != length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[4]


def test_pipeline_with_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given, count in ((docs, 4), (docs.limit(0), 0)):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, out, SF_DIR), f"awkward-{name}")
        assert out.count() == count


def test_texts_of_one_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text + " end"), (1, text), (5, "a text that is like nothing else in this table at all"), (7, text), (None, text)]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, given.repartition(3), SF_DIR)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)
