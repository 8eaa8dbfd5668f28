"""Token sequences of a fixed size, packed with minimum bin slack.

A text's ids are cut at every full window; what remains is shorter than a window. How
many remainders there are of each length is all that packing needs: at most
``capacity`` numbers, whatever the table's size. A window starts with the longest
length left, and a subset-sum over bitsets, one bit per reachable fill, picks those
remaining lengths that come closest to the capacity. The picked multiset is used as
often as its counts last, so each pick uses up a length. Spark then deals the pieces
of every length to the windows by their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.arrays import bound_batches
from fieldloom.llm.tokens import encoder
from fieldloom.session import written

CAPACITY = 1024
END_ID = 0
#: Pieces that are numbered together in one task.
BLOCK_PIECES = 50_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
PLAN = "length long, low long, high long, sequence long, each long, begin long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each text's ids and the end id, cut at every ``capacity`` ids.

    Returns ``doc_id, start, length, ids, doc_tokens``; ``ids`` are little-endian
    unsigned 32-bit numbers. Null texts are empty texts, of the end id alone.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids = encode.ids([t or "" for t in batch.column("text").to_pylist()])
            rows: list[list] = [[], [], [], [], []]
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                data = np.append(own, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(data), capacity):
                    piece = data[start : start + capacity]
                    for values, value in zip(rows, (doc_id, start, len(piece), piece.tobytes(), len(data)), strict=True):
                        values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            arrays = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to ``room`` without passing it."""
    reached, steps = 1, []
    window = (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reached >> room & 1:
            take = min(copies, left)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & window
            left -= take
            copies *= 2
        if reached >> room & 1:
            break
    at, picked = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return picked


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, low, high, sequence, each, begin)``.

    Pieces ``low`` to ``high - 1`` of that length go to the sequences from ``sequence``
    on, ``each`` to one, side by side from offset ``begin``.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        picked = fill(rest, capacity - longest)
        picked[longest] = picked.get(longest, 0) + 1
        times = min(left[n] // each for n, each in picked.items())
        begin = 0
        for length, each in sorted(picked.items(), reverse=True):
            rows.append((length, used[length], used[length] + each * times, sequence, each, begin))
            used[length] += each * times
            left[length] -= each * times
            if not left[length]:
                del left[length]
            begin += length * each
        sequence += times
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; any columns beside are kept.

    Needs ``doc_id, start, length``. Pieces are dealt by the hash and order of
    ``doc_id, start``; equal rows are dealt in any order, which shows in no column.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // BLOCK_PIECES))
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))
    numbered = pieces.withColumn("_block", block)
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "start")
    numbered = numbered.withColumn("_row", F.row_number().over(within) - 1).join(sizes, ["length", "_block"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_row"))
    # At most `capacity` patterns, each of fewer lengths than their sum allows.
    rows = spark.createDataFrame(plan(counts, capacity), PLAN).withColumnRenamed("length", "_length")
    on = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("low")) & (F.col("_number") < F.col("high"))
    place = F.col("_number") - F.col("low")
    return numbered.join(F.broadcast(rows), on).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("begin") + (place % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    pieces = token_pieces(docs, path, capacity, end_id)
    light = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packed(light, capacity)
