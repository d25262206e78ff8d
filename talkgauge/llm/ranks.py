"""Places of rows inside ordered groups of any size, without a window over a whole group.

Rows are dealt to partitions by ranges of (group, order) and sorted there, so a group of any size spreads
over neighbouring partitions.  ``at`` numbers the rows of each partition; a *run* is what one partition
holds of one group, and the rows of a run have consecutive numbers.  There are at most as many runs as
partitions and groups together, so what comes before a run is summed over runs and never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.llm.frames import stored

_IN_PART = (1 << 33) - 1  # monotonically_increasing_id counts the rows of a partition in its lower 33 bits


def part_of(at: Column) -> Column:
    return F.shiftright(at, 33)


def in_order(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The rows, stored, with ``at``: numbers that ascend with group and order and are dense in each run.

    Rows equal in all of these are told apart by where they were read, so that copies spread too.
    """
    keys = [*(F.col(c) for c in (*group, *order)), F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    return stored(dealt.sortWithinPartitions(*keys).drop("_tie").withColumn("at", F.monotonically_increasing_id()), label)


def runs(ordered: DataFrame, group: list[str], label: str) -> DataFrame:
    """One row per run: part, group, first and last ``at``, the rows of the group ``before`` it, the ``previous`` one's
    last ``at``, and ``size``, the rows of the whole group."""
    found = ordered.groupBy(part_of(F.col("at")).alias("part"), *group).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    rows, whole = F.col("last") - F.col("first") + 1, Window.partitionBy(*group)
    earlier = whole.orderBy("part")
    before = F.coalesce(F.sum(rows).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(found.select("*", before.alias("before"), F.lag("last").over(earlier).alias("previous"), F.sum(rows).over(whole).alias("size")), label)


def placed(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with ``place``, from 0, in their group and its ``size``; nulls come first and are a group of their own."""
    ordered = in_order(rows, group, order, label)
    found = runs(ordered, group, f"{label}-runs")
    renamed = found.select("part", "first", "before", "size", *[F.col(c).alias(f"_{c}") for c in group])
    same = part_of(F.col("at")) == F.col("part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.col("before") + F.col("at") - F.col("first")
    return ordered.join(renamed, same).select(*rows.columns, place.alias("place"), "size")
