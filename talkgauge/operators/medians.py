"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

# A quantile sketch of this accuracy has a rank error below 0.01 % of the group, so the
# bracket below holds the middle ranks; a group where it did not would raise an error.
_ACCURACY = 10_000
_BRACKET = (0.4995, 0.5005)
# Equal steps of the bracket; only the values of the steps with the middle ranks are ranked.
_STEPS = 4_096


def grouped_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: the interpolated median of each column, NULLs ignored.

    The built-in median keeps every value of a group in one task.  Integer columns (scores,
    turns) are counted per group and value, which combines before the shuffle, and those
    counts are ranked.  For other columns a bounded quantile sketch brackets the middle of
    each group, the bracket is cut into equal steps, and only values of the steps that hold
    the middle ranks are ranked.
    """
    keys = list(keys)
    whole = (ByteType, ShortType, IntegerType)
    counted = [c for c in columns if isinstance(df.schema[c].dataType, whole)]
    parts = [
        build(df, keys, chosen)
        for build, chosen in (
            (_of_integers, counted),
            (_of_doubles, [c for c in columns if c not in counted]),
        )
        if chosen
    ]
    medians = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return medians.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_metric") == c, F.col("_median"))).alias(f"{c}_median")
            for c in columns
        ]
    )


def _values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per value, with the column's name in `_metric`."""
    metrics = F.array(
        *[
            F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_value"))
            for c in columns
        ]
    )
    return df.select(*keys, F.inline(metrics)).filter(F.col("_value").isNotNull())


def _middle(first: Column, last: Column, total: Column) -> Column:
    """Whether the ranks first to last meet a middle rank of `total` values."""
    return (first <= F.ceil((total + 1) / 2)) & (last >= F.floor((total + 1) / 2))


def _of_integers(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    group = [*keys, "_metric"]
    counts = _values(df, keys, columns).groupBy(*group, "_value").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*group).orderBy("_value")
    last = F.sum("_n").over(order)
    total = F.sum("_n").over(Window.partitionBy(*group))
    ranked = counts.withColumns({"_last": last, "_total": total})
    return (
        ranked.filter(_middle(F.col("_last") - F.col("_n") + 1, F.col("_last"), F.col("_total")))
        .groupBy(*group)
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    )


def _of_doubles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    group = [*keys, "_metric"]
    values = _values(df, keys, columns)
    bracket = values.groupBy(*group).agg(
        F.percentile_approx("_value", list(_BRACKET), _ACCURACY).alias("_q")
    )
    # 0 below the bracket, 1 to _STEPS inside it, its end in the last step, _STEPS + 1 above
    low, high = F.col("_q")[0], F.col("_q")[1]
    inside = 1 + F.floor((F.col("_value") - low) / (high - low) * _STEPS).cast("int")
    step = (
        F.when(F.col("_value") < low, 0)
        .when(F.col("_value") > high, _STEPS + 1)
        .when(low == high, 1)
        .otherwise(F.least(inside, F.lit(_STEPS)))
    )
    placed = values.join(bracket, group).withColumn("_step", step).drop("_q")
    # counted in the tasks first: a group has as many rows here as steps, however many values it has
    steps = placed.groupBy(*group, "_step").agg(F.count("*").alias("_in_step"))
    whole = Window.partitionBy(*group)
    until, total = F.sum("_in_step").over(whole.orderBy("_step")), F.sum("_in_step").over(whole)
    chosen = (
        steps.withColumns({"_until": until, "_total": total})
        .filter(_middle(F.col("_until") - F.col("_in_step") + 1, F.col("_until"), F.col("_total")))
        .select(*group, "_step", "_total", (F.col("_until") - F.col("_in_step")).alias("_below"))
    )
    # only the values of these steps are shuffled
    found = [*group, "_step", "_below", "_total"]
    counts = placed.join(chosen, [*group, "_step"]).groupBy(*found, "_value").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(*group, "_step").orderBy("_value")
    ranked = counts.withColumn("_last", F.col("_below") + F.sum("_n").over(in_order))
    missed = F.col("_step").isin(0, _STEPS + 1)
    return (
        ranked.filter(_middle(F.col("_last") - F.col("_n") + 1, F.col("_last"), F.col("_total")))
        .withColumn(
            "_value",
            F.when(missed, F.raise_error(F.lit("the middle lies outside its bracket")).cast("double"))
            .otherwise(F.col("_value")),
        )
        .groupBy(*group)
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    )
