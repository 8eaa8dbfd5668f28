"""The dealt operators over their whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import (
    chat_format,
    conversations,
    decontamination,
    near_duplicates,
    packing,
    passages,
    pii,
    quality,
    ring,
    token_counts,
    topk,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.personal_data(docs, pii.fit_pii(docs)))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


#: A conversation whose texts hold control strings, added to the table's.
CONFLICT = """
SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS turns (turn, role)
"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.formatted_conversations(rows.union(spark.sql(CONFLICT))))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    return quality.scored(docs, quality.fit_quality(docs, labels))


@query
def op6_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontamination.contaminated(docs, decontamination.fit_leaks(docs, table(spark, sf_dir, "benchmark")))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.digest(ring.sharded(table(spark, sf_dir, "documents")))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whitened(table(spark, sf_dir, "embeddings")))
