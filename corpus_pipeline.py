"""A corpus pipeline of five operators over ``documents``.

Toxic texts go, one text of each near-duplicate group stays, texts with benchmark
passages go, personal data is replaced, and what is left is packed into sequences.
Each stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, near_duplicates, packing, pii, toxicity
from fieldloom.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that are not toxic, by a model of the labelled ones among ``docs``."""
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates: the one with the smallest id.

    Rows without an id or without words are no duplicates of anything. Of repeated
    rows with one id and text one stays. Different texts of one id are told apart: a
    row goes only if its own text is in a group whose kept text stays.
    """
    text_key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(*COLUMNS, text_key.alias("_key"))
    found = near_duplicates.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    found = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_key"))
    found = found.agg(F.min("component_id").alias("_group"), (F.count(F.lit(1)) > 1).alias("_repeated"))
    ids = keyed.filter("_key is not null").groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    found = written(found.join(ids, "_key"), "text-groups")
    # Written, so that the join stands on plain tables and Spark can split a large group.
    first = written(found.groupBy("_group").agg(F.min(F.struct("doc_id", "_key")).alias("_first")), "group-firsts")
    kept = (F.col("_first._key") == F.col("_key")).alias("_kept")
    # The marks grow with the table, so they are never broadcast, whatever their number.
    marks = found.join(first, "_group").select("_key", "_repeated", kept).filter("not _kept or _repeated").hint("merge")
    rest = keyed.join(marks, "_key", "left").filter("_kept is null or _kept")
    single = rest.filter("_repeated is null").select(*COLUMNS)
    return single.union(rest.filter("_repeated").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that hold no benchmark item."""
    models = decontamination.fit_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return decontamination.without_leaks(docs, models).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced by its kind; ``n_chars`` is counted anew."""
    text = pii.redacted(F.col("text"), pii.fit_pii(docs))
    changed = docs.select("doc_id", text.alias("text"), "lang", "source", F.col("text").alias("_before"), "n_chars")
    n_chars = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(F.length("text"))
    return changed.withColumn("n_chars", n_chars.cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]

#: Fitted models and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
