"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import written

#: Labelled rows that a classifier is fitted on, as a mean: rows are taken by the
#: hash of their id, at a rate that makes about so many of all labelled rows.
SAMPLE_ROWS = 12_000


#: Steps of a sampling rate; what is left of a step is decided by a second hash.
RATE_STEPS = 1_000_000


def taken(mark: Column, wanted: int, total: int) -> Column:
    """Whether a row with the hash ``mark`` is among about ``wanted`` of ``total`` rows.

    The rate is exact for any total: a fraction of a step counts as well, so the sample
    does not vanish however large the table is.
    """
    rate = min(1.0, wanted / max(1, total)) * RATE_STEPS
    step = F.pmod(mark, F.lit(RATE_STEPS))
    rest = F.pmod(F.xxhash64(mark, F.lit(37)), F.lit(1 << 62)) < int((rate - int(rate)) * (1 << 62))
    return (step < int(rate)) | ((step == int(rate)) & rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most about ``rows`` labelled texts, written once.

    Rows without id or label take no part. Of several labels of one id the greatest
    counts. Exact copies of a text count once in a class, under their smallest id, however often
    a row is repeated; a text that is labelled in two classes counts in both.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    known = known.filter(taken(F.xxhash64("doc_id", F.lit(29)), rows, known.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # About `rows` rows of two numbers: a bounded broadcast.
    found = texts.join(F.broadcast(known), "doc_id")
    # Copies are reduced before they are moved.
    copies = found.groupBy("label", F.xxhash64("text").alias("mark")).agg(
        F.min("doc_id").alias("doc_id"), F.first("text").alias("text")
    )
    return written(copies.select("doc_id", "text", "label"), "sample")
