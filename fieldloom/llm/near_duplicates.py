"""Near-duplicate texts by fast similarity sketching, banding and exact checks.

A sketch has ``COORDINATES`` values. In round ``i`` every shingle is placed in one
hashed bin with a value in ``[i, i + 1)``, and bins keep their smallest value; after
as many rounds as there are bins, shingles go to each bin in turn. All bins fill,
whatever the size of the set, and the share of equal values is concentrated around
the Jaccard similarity. Texts with equal sets are one class. Classes that share a
band of values are candidates; each link is confirmed on the full shingle sets.

Large buckets are never unfolded to all pairs. Every bucket first links its members
to its most central one. What that joins is one component and needs no more pairs.
Then members of different components are compared: all of them in small buckets; in
larger ones those that share a shingle among the rarest ones that two sets of such
a similarity must share (a prefix filter, which loses no link).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.arrays import Words, bound_batches, mixed, odd_constants
from fieldloom.llm.components import components
from fieldloom.session import written

COORDINATES = 256
SHINGLE_WORDS = 5
PERCENT = 80
#: The chance to miss a pair just at the threshold that the banding may have.
MISS = 1e-4
#: Members of different components in one bucket up to which all pairs are compared.
SMALL_BUCKET = 24

SKETCH_SCHEMA = "doc_id long, n_shingles long, mark long, mark2 long, bands array<long>"
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_rows(percent: int, coordinates: int = COORDINATES) -> int:
    """The most rows of a band at which the threshold is missed at most ``MISS`` times."""
    similarity = percent / 100
    fitting = [r for r in range(1, 33) if (1 - similarity**r) ** (coordinates // r) <= MISS]
    return max(fitting, default=1)


def sketch(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` values per set. Empty sets keep ``EMPTY``."""
    out = np.full(len(sets) * coordinates, EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = odd_constants(2 * coordinates, 7)
    for step in range(2 * coordinates):
        if not len(values):
            break
        hashed = mixed(values * seeds[step] + seeds[step])
        bins = (hashed % np.uint64(coordinates)).astype(np.int64) if step < coordinates else step - coordinates
        # The round leads, so a bin that is filled keeps its value.
        np.minimum.at(out, owner * coordinates + bins, np.uint64(step << 48) | (hashed >> np.uint64(16)))
        hollow = (out.reshape(-1, coordinates) == EMPTY).any(axis=1)
        keep = hollow[owner]
        if not keep.all():
            values, owner = values[keep], owner[keep]
    return out.reshape(-1, coordinates)


def _sketches(words: int, rows: int):
    bands = COORDINATES // rows
    constants = odd_constants(rows, 11)
    salt = odd_constants(bands, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(Words(batch.column("text")).shingle_sets(words))
            values = sketch(sets)[:, : bands * rows].reshape(len(sets), bands, rows)
            keys = mixed((mixed(values ^ constants) * constants).sum(axis=2) ^ salt).view(np.int64)
            marks = [[int((mixed(s ^ c) * c).sum().view(np.int64)) for s in sets] for c in odd_constants(2, 17)]
            sizes = np.array([len(s) for s in sets], np.int64)
            filled = np.repeat(sizes > 0, bands)
            ends = np.concatenate(([0], np.cumsum((sizes > 0) * bands)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    *[pa.array(m, pa.int64()) for m in marks],
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1)[filled])),
                ],
                ["doc_id", "n_shingles", "mark", "mark2", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in Words(batch.column("text")).shingle_sets(words)]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.int64)])
            marks = [int(mixed(s.view(np.uint64)).sum().view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "set", "shingles"],
            )

    return run


def _alike(percent: int) -> Column:
    shared = F.size(F.array_intersect("left.shingles", "right.shingles"))
    return 100 * shared >= percent * (F.size("left.shingles") + F.size("right.shingles") - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.struct("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.struct("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").filter(_alike(percent)).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among ``members (doc_id, label)`` that may be alike.

    Shingles are ordered from rare to common. Of sets with at least ``percent``
    similarity the smaller shares one of its first ``n - 2np/(100+p) + 1`` with the
    first ``m - mp/100 + 1`` of the larger, and from there enough must remain. Each of
    several sets of one id has its own order.
    """
    shingles = sets.join(members, "doc_id").select(
        "doc_id", "set", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
    )
    counted = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # A shingle of one text only pushes the others back and is never joined.
    ranked = shingles.join(counted, "shingle", "left").withColumn(
        "place",
        F.row_number().over(
            Window.partitionBy("doc_id", "set").orderBy(F.coalesce("copies", F.lit(1)), "shingle")
        ),
    )
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    front = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    ranked = written(
        ranked.filter((F.col("place") <= reach) & F.col("copies").isNotNull()).select(
            "doc_id", "label", "n", "shingle", "place", (F.col("place") <= front).alias("front")
        ),
        "prefixes",
    )
    x, y = ranked.filter("front").alias("x"), ranked.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    ordered = F.struct("x.n", "x.doc_id") < F.struct("y.n", "y.doc_id")
    near = 100 * F.col("x.n") >= percent * F.col("y.n")
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & ordered & near
    return x.join(y, on & (left >= need)).select(*_pair("x.doc_id", "y.doc_id")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """Components of texts with at least ``percent`` % Jaccard similarity of word shingles.

    Takes ``doc_id`` and ``text`` of ``docs``, whatever else it has. Returns per row
    ``doc_id, n_shingles, component_id, kept``: the size of its set, the smallest
    doc_id reachable over links, and whether the row's own id is that.

    Null texts are empty texts; those and texts of blanks have 0 shingles and no
    links. Repeated rows give repeated rows; they are one row while links are searched.
    Links are those of ids: an id with several texts has the links of all. A row without doc_id has no links, a
    null component and is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = band_rows(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(texts.mapInArrow(_sketches(words, rows), SKETCH_SCHEMA), "sketches")

    marks = ["mark", "mark2", "n_shingles"]
    linkable = sketches.filter("n_shingles > 0 and doc_id is not null")
    # Written, so that the join at the end stands on plain tables and Spark can split a
    # class that holds very many rows.
    classes = written(linkable.groupBy(*marks).agg(F.min("doc_id").alias("first_id")), "classes")
    first = classes.select(F.col("first_id").alias("doc_id"))
    unique = linkable.join(first, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    places = written(unique.distinct(), "places")

    shared = places.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(places.join(shared, "band"), "members")
    central = members.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    weighed = members.join(central, "doc_id")
    hubs = weighed.groupBy("band").agg(F.max(F.struct("weight", -F.col("doc_id"))).alias("top"))
    hubs = hubs.select("band", (-F.col("top")["col2"]).alias("hub"))
    pairs = members.join(hubs, "band").filter("doc_id != hub").select(*_pair("doc_id", "hub"))
    pairs = written(pairs.distinct(), "pairs")

    # The ids grow with the table, so they are never broadcast, whatever their number.
    used = members.select("doc_id").distinct().hint("merge")
    rows_used = texts.join(used, "doc_id", "left_semi")
    # Rows of repeated ids are reduced to their different texts; others are not moved for that.
    repeated = linkable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    repeated = written(repeated, "repeated").hint("merge")
    single = rows_used.join(repeated, "doc_id", "left_anti")
    several = rows_used.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)))
    # An id with several texts has the links of all of them.
    sets = single.select("doc_id", "text").union(several.select("doc_id", "text"))
    sets = written(sets.mapInArrow(_sets(words), "doc_id long, set long, shingles array<long>"), "sets")
    links = written(_confirmed(pairs, sets, percent), "links")
    labels = components(links)

    labelled = members.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "band", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    labelled = written(labelled, "labelled")
    open_bands = (
        labelled.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
        .filter("low < high")
        .select("band", "members")
    )
    rest = written(labelled.join(open_bands, "band"), "open")
    small = rest.filter(F.col("members") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") < F.col("y.doc_id"))
    within = x.join(y, on & (F.col("x.label") != F.col("y.label"))).select(*_pair("x.doc_id", "y.doc_id"))
    large = rest.filter(F.col("members") > SMALL_BUCKET).select("doc_id", "label").distinct()
    more = within.union(_prefix_pairs(written(large, "large"), sets, percent)).distinct()
    more = more.join(pairs, ["a", "b"], "left_anti")
    found = written(_confirmed(more, sets, percent), "more-links")
    labels = components(links.union(found))

    # The component of a class is joined to the few columns of the classes first.
    found_in = classes.join(labels, F.col("first_id") == F.col("node"), "left")
    found_in = written(found_in.select(*marks, "first_id", "component"), "class-components")
    named = sketches.select("doc_id", *marks).join(found_in, marks, "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "first_id"))
    component = F.coalesce(linked, F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
