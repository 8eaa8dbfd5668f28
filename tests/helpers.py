"""A small catalogue with one field per kind, and record builders."""

import json

from pyspark.sql import functions as F

from fieldloom.catalog import Catalog, FieldSpec, NameParts

CATALOG = Catalog(
    fields=(
        FieldSpec("number", "digits", low=9, high=14, shard_prefix=4, shard_hash=2, pattern=r"\A\+?[0-9]{8,15}\z"),
        FieldSpec("code10", "digits_exact", lengths=(10, 12), shard_prefix=4, shard_hash=1),
        FieldSpec("account", "digits_any", shard_prefix=4, shard_hash=1),
        FieldSpec("mail", "email", shard_prefix=4, shard_hash=1),
        FieldSpec("full_name", "words", shard_prefix=4, shard_hash=1),
        FieldSpec("day", "date", shard_prefix=4, shard_hash=1),
        FieldSpec("plate", "code"),
        FieldSpec("note_id", "text", indexed=False),
    ),
    names=NameParts("full_name", ("surname", "name", "middle")),
)

RAW = "map<string,string>"


def records(spark, rows, source="people"):
    """Rows of raw records, numbered from 1, as ``source_table, seq, raw``.

    They go through JSON text, which keeps the order of keys.
    """
    data = [(source, i, json.dumps(raw, ensure_ascii=False)) for i, raw in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "source_table string, seq bigint, text string")
    return df.select("source_table", "seq", F.from_json("text", RAW).alias("raw"))


def one(spark, value, expression):
    """An expression of one text value."""
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())
