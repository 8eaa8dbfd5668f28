"""Token counts of whole texts; huge texts are cut, encoded apart and spliced.

A huge text is cut into chunks that overlap, so its work spreads over tasks. The split
of a byte-level BPE depends only on what follows a place where a piece begins. So from
the first place where two neighbouring chunks both begin a piece, and which the left
one has seen enough text after, their tokens agree: there they are spliced. Where an
overlap has no such place, the text is cut anew with chunks and overlaps twice as
wide, at last into one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import bound_batches
from fieldloom.llm.tokens import encoder
from fieldloom.session import written

#: Code points of a chunk and of an overlap. Texts up to a chunk are encoded whole.
CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024

CHUNKS = "mark string, part long, last boolean, begin long, text string"
EDGES = (
    "mark string, part long, last boolean, n_tokens long, "
    "heads array<long>, head_tokens array<long>, tails array<long>, tail_tokens array<long>"
)


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(batch.column("mark").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = max(1, -(-len(text) // chunk))
                for part in range(parts):
                    begin = part * chunk
                    row = [[mark], [part], [part == parts - 1], [begin], [text[begin : begin + chunk + overlap]]]
                    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
                    arrays = [pa.array(v, k) for v, k in zip(row, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["mark", "part", "last", "begin", "text"])

    return run


def _encoded(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        # A special string that the chunk's end cuts is not seen as one.
        margin = max([1, *map(len, encode.special)])
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row in batch.to_pylist():
                begin, text = row["begin"], row["text"]
                at, tokens, total = encode.boundaries(text)
                at = at + begin
                head = at < begin + overlap
                # The last piece may go on, but where it begins is settled.
                tail = (at >= begin + chunk) & (at <= begin + len(text) - margin)
                sides = [at[head], tokens[head], at[tail], tokens[tail]]
                for values, value in zip(out, [row["mark"], row["part"], row["last"], total, *sides], strict=True):
                    values.append(value)
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            names = ["mark", "part", "last", "n_tokens", "heads", "head_tokens", "tails", "tail_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return run


def _tokens_at(places: str, tokens: str, place: str) -> Column:
    return F.get(F.col(tokens), (F.array_position(places, F.col(place)) - 1).cast("int"))


def _spliced(edges: DataFrame) -> DataFrame:
    """``mark, n_tokens``, null where two neighbours have no common place."""
    left = edges.filter("not last").select("mark", "part", "tails", "tail_tokens")
    right = edges.filter("part > 0").select("mark", (F.col("part") - 1).alias("part"), "heads", "head_tokens")
    seams = left.join(right, ["mark", "part"]).withColumn("seam", F.array_min(F.array_intersect("tails", "heads")))
    seams = seams.select(
        "mark",
        (_tokens_at("tails", "tail_tokens", "seam") - _tokens_at("heads", "head_tokens", "seam")).alias("tokens"),
    )
    ends = edges.filter("last").select("mark", F.col("n_tokens").alias("tokens"))
    every = seams.union(ends).groupBy("mark")
    return every.agg(
        F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("n_tokens")
    )


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``mark, n_tokens`` of ``texts (mark, text)`` by chunks."""
    done = None
    while True:
        parts = texts.mapInArrow(_cut(chunk, overlap), CHUNKS)
        spread = parts.repartition("mark", "part")
        edges = written(spread.mapInArrow(_encoded(path, chunk, overlap), EDGES), "edges")
        counts = written(_spliced(edges), "spliced")
        good = counts.filter("n_tokens is not null")
        done = good if done is None else done.union(good)
        left = counts.filter("n_tokens is null").select("mark")
        if left.isEmpty():
            return done
        texts = texts.join(left, "mark", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``.

    Takes ``doc_id`` and ``text``, whatever else there is. Null texts are empty texts
    of 0 bytes and tokens. Repeated rows give repeated rows; ids may be null.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    huge = F.length("text") > chunk

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        given = column.to_pylist()
        ids = encoder(path).ids([t for t in given if t is not None])
        sizes = iter([len(i) for i in ids])
        return pa.array([None if t is None else next(sizes) for t in given], pa.int64())

    size = F.octet_length("text").cast("long").alias("n_bytes")
    mark = F.when(huge, F.sha2(F.col("text").cast("binary"), 256)).alias("mark")
    rows = texts.select("doc_id", size, counted(F.when(~huge, F.col("text"))).alias("own"), mark)
    # Equal texts count once: one row per text, which then stands for all its copies.
    distinct = texts.filter(huge).select(mark, "text").groupBy("mark").agg(F.any_value("text").alias("text"))
    large = huge_counts(distinct, path, chunk, overlap)
    tokens = F.coalesce("own", "n_tokens")
    return rows.join(large, "mark", "left").select(
        "doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit")
    )
