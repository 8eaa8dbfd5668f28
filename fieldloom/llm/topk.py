"""Exact top-k search by inner product with MaxScore over shards.

Components of a vector are its terms. Within a shard every component has a greatest
and a least value, so for a query each term has bounds of what it can add. Terms with
the widest bounds are essential: their postings are traversed for all vectors of the
shard. The other terms cannot lift a vector over the k-th best score by themselves;
they are probed, a few at a time, only for vectors that can still get there.

Queries are a stated set of rows, taken in blocks. A task reads the shards of its group one
after the other against one block and keeps the block's k best, whose last score is a bound for
the next shard. So neither shards nor blocks are copied or shuffled to meet, a task holds one of each
whatever their number, and its result is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.session import written

SHARD_ROWS = 8_192
BLOCK_QUERIES = 2_048
#: Bytes of the components of a shard or a block, so that these stay small for wide vectors.
ROW_BYTES = 8 << 20
#: Tasks for each core, while there are shards for them.
TASKS = 4
#: Vectors scored in full first, to have a k-th best score.
SEED_ROWS = 256
#: Terms probed at a time.
PROBE = 8

FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _dense(rows: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows, filled up with zeros."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray) -> type:
    """Doubles where every partial sum stays an exact whole number, else integers."""
    most = np.abs(queries.astype(float)).max(initial=0) * np.abs(vectors.astype(float)).max(initial=0)
    return np.float64 if most * vectors.shape[1] < 2**53 else np.int64


def shard_top(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    k: int,
    copies: np.ndarray | None = None,
    bars: list | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's ``k`` best vectors of one shard: (query, ids, scores); ties to smaller ids.

    ``copies``: how often each vector counts. ``bars``: per query the score that vectors have
    to reach, or None; lower ones may be left out.
    """
    kind = _exact(queries, vectors)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    copies = None if copies is None else copies[order]
    # One row per term: its postings.
    postings = np.ascontiguousarray(vectors[order].T.astype(kind))
    high, low = postings.max(axis=1, initial=0), postings.min(axis=1, initial=0)
    bars = [None] * len(query_ids) if bars is None else bars
    for query_id, query, given in zip(query_ids, queries.astype(kind), bars, strict=True):
        most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
        by_width = np.argsort(least - most, kind="stable")
        own = np.flatnonzero(ids == query_id)
        seed = query @ postings[:, : SEED_ROWS + len(own)]
        seed = np.delete(seed, own[own < len(seed)])
        bar = given
        if len(seed) >= k:
            least_seed = np.partition(seed, len(seed) - k)[len(seed) - k]
            bar = least_seed if bar is None else max(bar, least_seed)
        if bar is not None:
            rest_most = np.concatenate([np.cumsum(most[by_width][::-1])[::-1], [0]])
            least_before = np.concatenate([[0], np.cumsum(least[by_width])])
            # Terms from here on cannot reach the bar without more than the least of the others.
            enough = np.flatnonzero(least_before + rest_most < bar)
            split = int(enough[0]) if len(enough) else len(query)
            split = max(split, min(PROBE, len(query)))
        else:
            split = len(query)
        terms = by_width[:split]
        score = query[terms] @ postings[terms]
        alive = np.arange(len(ids))
        while split < len(query):
            able = score + rest_most[split] >= bar
            alive, score = alive[able], score[able]
            terms = by_width[split : split + PROBE]
            score = score + query[terms] @ postings[np.ix_(terms, alive)]
            split += PROBE
        keep = ids[alive] != query_id
        alive, score = alive[keep], score[keep]
        if len(score) > k:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= bar], score[score >= bar]
        # Ids ascend, so a stable sort leaves ties in their order.
        best = np.argsort(-score, kind="stable")[:k]
        if copies is not None:
            best = np.repeat(best, np.minimum(copies[alive[best]], k))[:k]
        yield query_id, ids[alive[best]], score[best].astype(np.int64)


def _merged(one: tuple, other: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of two lists of ids and scores; ties to smaller ids."""
    ids, scores = (np.concatenate(c) for c in zip(one, other, strict=True))
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _searched(k: int, width: int):
    """The ``k`` best of each query over the shards that a task reads, whatever the order of blocks and shards."""

    def side(batch: pa.RecordBatch, name: str, row: int) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        items = batch.column(name)[row].values
        return items, items.field("vec_id").to_numpy(zero_copy_only=False), _dense(items.field("q"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                if block not in blocks:
                    _, query_ids, queries = side(batch, "queries", row)
                    blocks[block] = [query_ids, queries, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)]
                query_ids, queries, best = blocks[block]
                items, ids, vectors = side(batch, "vectors", row)
                copies = items.field("copies").to_numpy(zero_copy_only=False)
                bars = [scores[-1] if len(scores) == k else None for _, scores in best]
                found = shard_top(query_ids, queries, ids, vectors, k, copies, bars)
                blocks[block][2] = [_merged(old, new[1:], k) for old, new in zip(best, found, strict=True)]
        for query_ids, _, best in blocks.values():
            sizes = [len(ids) for ids, _ in best]
            ids, scores = (np.concatenate(c) for c in zip(*best, strict=True))
            columns = [pa.array(c, pa.int64()) for c in (np.repeat(query_ids, sizes), ids, scores)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other vectors.

    Takes ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    Vectors that are null, or hold a null or a number that is not finite, take no
    part, nor do rows without id. Shorter vectors count as filled up with zeros.
    Rows with the query's id are not its neighbours; other repeated rows each count.
    """
    spark = vectors.sparkSession
    given = vectors.filter(F.col("vec_id").isNotNull() & _whole(F.col("embedding")))
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("q"))
    # Equal rows are counted first, so that a row repeated very often stays one row of a shard.
    given = written(given.groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    counts = given.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("q"))).first()
    width = counts[2] or 1
    sizes = [max(1, min(size, ROW_BYTES // (8 * width))) for size in (shard_rows, BLOCK_QUERIES)]
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(counts[:2], sizes, strict=True))
    # The fewer the groups, the sooner a query's bound is high; with enough blocks there is one.
    groups = min(shards, max(1, -(-TASKS * spark.sparkContext.defaultParallelism // blocks)))

    def listed(rows: DataFrame, number: Column, count: int, key: str, name: str) -> DataFrame:
        # As many partitions as lists, so that a task holds few of them.
        dealt = rows.withColumn(key, number).repartitionById(count, F.col(key).cast("int"))
        return written(dealt.groupBy(key).agg(F.collect_list(F.struct("vec_id", "q", "copies")).alias(name)), f"{key}s")

    # Repeated ids are spread by their vectors.
    sharded = listed(given, F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)), shards, "shard", "vectors")
    asked = listed(given.filter(is_query), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)), blocks, "block", "queries")
    # Each block in a task with each group of shards, which is read and not copied.
    asked = asked.repartitionById(blocks, F.col("block").cast("int")).hint("shuffle_replicate_nl")
    group = F.pmod("shard", F.lit(groups)).cast("int")
    pairs = sharded.repartitionById(groups, group).crossJoin(asked).select("block", "queries", "vectors")
    # A row holds a whole shard and a block of queries.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")
    try:
        found = written(pairs.mapInArrow(_searched(k, width), FOUND), "found")
    finally:
        spark.conf.set(setting, before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
