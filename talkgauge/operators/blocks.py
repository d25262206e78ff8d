"""Ordered computations inside groups of any size.

A session or batch may hold a large share of all rows, so no operator orders a whole
group in one task.  Rows are cut into blocks of consecutive positions; each block is
ordered on its own, block totals (one row per block) carry the state from block to
block, and the carried value is joined back on (group, block).  For groups that fit in
one block, which is the usual case, this costs one narrow pre-aggregation more than a
plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK = "_block"


def with_block(df: DataFrame, position: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block number of a row from its integer position in the group."""
    return df.withColumn(BLOCK, F.floor(F.col(position) / F.lit(block_rows)).cast("bigint"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    include_current: bool = True,
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Running sum of `value` in each group, ordered by the integer column `position`.

    With `keep_block` the block column stays, and so does the partitioning by group and
    block, for whoever goes on to aggregate by them.
    """
    blocked = with_block(df.withColumn("_value", value), position, block_rows)
    last = 0 if include_current else -1
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    earlier_blocks = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, BLOCK, F.sum("_total").over(earlier_blocks).alias("_carried"))
        .filter(F.col("_carried").isNotNull())
    )
    total = F.coalesce(F.col("_inside"), F.lit(0)) + F.coalesce(F.col("_carried"), F.lit(0))
    summed = (
        blocked.withColumn("_inside", F.sum("_value").over(inside))
        .join(carried, [*keys, BLOCK], "left")
        .withColumn(name, total)
        .drop("_value", "_inside", "_carried")
    )
    return summed if keep_block else summed.drop(BLOCK)


def spread_over_blocks(per_group: DataFrame, last_position: Column, block_rows: int) -> DataFrame:
    """Repeat a group's row once per block up to the block of `last_position`."""
    last_block = F.floor(last_position / F.lit(block_rows)).cast("bigint")
    return per_group.withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
