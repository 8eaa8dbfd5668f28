"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many places of the ring; a row belongs to the arc its text's
hash falls into, so equal texts lie together. A shard takes the rows of its arcs up
to its capacity, and what overflows goes on clockwise, round by round, until
all have found room. The ring only needs the number of rows per arc for that, so the
flow is worked out on one number per virtual node, and each row reads its shard and
slot off its rank in ring order.

Ranks come from a range partitioning over the whole order: an arc with a third of
all rows fills many partitions. Equal rows are counted first and unfolded last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import mixed
from fieldloom.session import written

VIRTUAL_NODES = 64
#: Places of the ring, as bits.
RING_BITS = 12
#: Copies of one row unfolded at a time.
CHUNK = 10_000

ORDER = ("arc", "position", "text_crc32", "size", "doc_id")
RANKED = "arc int, doc_id {kind}, size long, text_crc32 long, copies long, part int, before long"


def ring(shards: int, virtual: int = VIRTUAL_NODES, bits: int = RING_BITS) -> tuple[list[int], np.ndarray]:
    """The shard of each arc, clockwise, and the arc of each place of the ring.

    A virtual node's place depends on its shard and number alone. An arc ends at its
    node; of two nodes at one place the one with the smaller hash stays.
    """
    nodes = np.arange(shards, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(1, virtual + 1, dtype=np.uint64)
    hashes = mixed(mixed(nodes.ravel()) + np.uint64(0x5851F42D4C957F2D))
    owner: dict[int, int] = {}
    for at in np.argsort(hashes, kind="stable"):
        owner.setdefault(int(hashes[at]) >> (64 - bits), int(at) // virtual)
    places = np.array(sorted(owner))
    arcs = np.searchsorted(places, np.arange(1 << bits)) % len(places)
    return [owner[int(p)] for p in places], arcs


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard takes: without slack the counts are at most one apart."""
    if slack:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(totals: Sequence[int], owner: Sequence[int], capacity: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Where the rows of each arc go: ``(arc, first, count, shard)``, ``first`` counting within the arc.

    In each round every arc offers what waits there to its shard; the rest waits
    at the next arc clockwise.
    """
    room = list(capacity)
    waiting = {arc: [(arc, 0, total)] for arc, total in enumerate(totals) if total}
    taken = []
    while waiting:
        onwards: dict[int, list] = {}
        for arc in sorted(waiting):
            shard = owner[arc]
            for origin, first, count in waiting[arc]:
                some = min(count, room[shard])
                if some:
                    room[shard] -= some
                    taken.append((origin, first, some, shard))
                if count > some:
                    onwards.setdefault((arc + 1) % len(owner), []).append((origin, first + some, count - some))
        waiting = onwards
    return taken


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in ring order, each with the number of rows before it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        copies = batch.column("copies").to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(copies)
        columns = [batch.column(c) for c in ("arc", "doc_id", "size", "text_crc32", "copies")]
        columns += [pa.array(np.full(len(copies), part, np.int32)), pa.array(ends - copies)]
        if len(copies):
            before = int(ends[-1])
        yield pa.RecordBatch.from_arrays(columns, ["arc", "doc_id", "size", "text_crc32", "copies", "part", "before"])


def _unfolded(runs: DataFrame) -> DataFrame:
    """One row per copy. Runs of very many copies are cut and dealt out before."""
    out = [c for c in runs.columns if c not in ("count", "slot")]
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy")
    few = runs.filter(F.col("count") <= CHUNK)
    starts = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CHUNK).cast("long"))
    many = runs.filter(F.col("count") > CHUNK).select(*out, "slot", "count", F.explode(starts).alias("start"))
    many = many.select(
        *out, (F.col("slot") + F.col("start")).alias("slot"), F.least(F.lit(CHUNK), F.col("count") - F.col("start")).alias("count")
    )
    dealt = many.repartition("slot")
    both = few.select(*out, "slot", "count").unionByName(dealt)
    return both.select(*out, "slot", each).select(*out, (F.col("slot") + F.col("copy")).alias("slot"))


def sharded(
    documents: DataFrame, shards: int = 8, virtual: int = VIRTUAL_NODES, slack: float = 0.0
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row's shard and its place there.

    Takes ``doc_id`` and ``text``; other columns are ignored. ``size`` is the UTF-8
    bytes of the text plus 1 and the checksum that of the text; a null text counts as
    empty in both, but is a group of its own on the ring. Without ``slack`` the shards' row
    counts are at most one apart; with it a shard may hold so much more than the mean,
    and fewer rows leave their arc. Slots of a shard are 0, 1, 2 ... without gaps.
    Every row is placed, rows without id too; repeated rows each get a slot. An empty
    table gives an empty result. Equal texts share a shard unless it overflows.
    """
    spark = documents.sparkSession
    text = F.col("text")
    owner, arcs = ring(shards, virtual)
    listed = ",".join(map(str, arcs))
    arc = F.get(F.expr(f"cast(split('{listed}', ',') as array<int>)"), F.shiftrightunsigned("position", 64 - RING_BITS).cast("int"))
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("position"),
    )
    counted = narrow.groupBy("doc_id", "size", "text_crc32", "position").agg(F.count(F.lit(1)).alias("copies"))
    ordered = counted.withColumn("arc", arc).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ranked = written(ordered.mapInArrow(_numbered, RANKED.format(kind=kind)), "ring")

    # One number per partition and per arc: bounded by the tasks and the virtual nodes.
    parts = sorted(ranked.groupBy("part").agg(F.max(F.col("before") + F.col("copies"))).collect())
    totals = dict(ranked.groupBy("arc").agg(F.sum("copies")).collect())
    rows = sum(totals.values())
    offsets, seen = [], 0
    for part, count in parts:
        offsets.append((part, seen))
        seen += count
    by_arc = [totals.get(a, 0) for a in range(len(owner))]
    begins = np.concatenate(([0], np.cumsum(by_arc))).tolist()
    segments, filled = [], [0] * shards
    for origin, first, count, shard in flow(by_arc, owner, capacities(rows, shards, slack)):
        segments.append((origin, begins[origin] + first, begins[origin] + first + count, shard, filled[shard]))
        filled[shard] += count
    offset_rows = spark.createDataFrame(offsets, "part int, part_begin long")
    segment_rows = spark.createDataFrame(segments, "arc int, first long, last long, shard int, first_slot long")

    rank = F.col("part_begin") + F.col("before")
    placed = ranked.join(offset_rows, "part").withColumn("rank", rank)
    # Rows of an arc are split only where a shard becomes full, so there are no more segments
    # than arcs and shards together: a bounded broadcast.
    met = placed.join(F.broadcast(segment_rows), "arc")
    begin, end = F.greatest("rank", "first"), F.least(F.col("rank") + F.col("copies"), "last")
    runs = met.filter(begin < end).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + begin - F.col("first")).alias("slot"), (end - begin).alias("count")
    )
    return _unfolded(runs)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
