"""Running totals and positions over large ordered groups.

A window over one group runs in one task, so a source that holds a third of all
rows would stall it. Here a group is cut into blocks that follow its order. Only
block totals meet in one task per group; rows only meet their own block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 100_000


def block_of(order: Column, rows: int = BLOCK_ROWS) -> Column:
    """The block of a dense integer order column."""
    return F.floor(order / rows).cast("bigint")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    block: Column,
) -> DataFrame:
    """Add, per name in ``totals``, the sum of that value over all earlier rows.

    ``block`` must not decrease along ``order``, and ``order`` must be unique
    within a group. The row itself is not included.
    """
    # As one struct, group columns may hold nulls: structs compare them as equal.
    group = F.struct(*by) if by else F.lit(0)
    rows = df.withColumn("_group", group).withColumn("_block", block)
    for name, value in totals.items():
        rows = rows.withColumn(f"_v_{name}", value)
    keys = ["_group", "_block"]

    sums = rows.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    earlier_blocks = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, *[F.coalesce(F.sum(f"_s_{n}").over(earlier_blocks), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )

    earlier_rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    located = rows.join(offsets, keys)
    return located.select(
        *df.columns,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(earlier_rows), F.lit(0))).cast("bigint").alias(n)
            for n in totals
        ],
    )
