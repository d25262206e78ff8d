"""Report figures as states that are stored by day and merged, so that no old result is read again.

A *cell* is the sums of all results of a batch and day that agree in scenario, status, score and turns:
every statistic of whole numbers, medians included, follows from cells exactly, and so do means and
extremes of durations.  Cells number by the values that occur, not by the results.  Durations have, besides, a
bounded quantile sketch per batch and day.  Cells add up and sketches merge, in any order and grouping.

Only the median of durations is approximate: with sketches of size `k`, its rank is off by at most
``rank_error(k)`` of the durations, in 99 of 100 cases, however many states are merged.  The
exact one is `reports.duration_stats`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import numbers
from talkgauge.plans import reports

SKETCH_SIZE = 1_000
_SCORE, _TURNS = "score", "turns"
_CELL = ["batch_id", "day", "scenario", "status", _SCORE, _TURNS]
_SUMS = {
    "n": F.sum,
    "duration_n": F.sum,
    "duration_sum": F.sum,
    "duration_min": F.min,
    "duration_max": F.max,
}
CELLS = (
    "batch_id STRING, scenario STRING, status STRING, score INT, turns INT, n BIGINT, duration_n BIGINT,"
    " duration_sum DOUBLE, duration_min DOUBLE, duration_max DOUBLE, day DATE"
)
SKETCHES = "batch_id STRING, durations BINARY, day DATE"


class States(NamedTuple):
    """`cells` and `sketches`, each with batch_id and day."""

    cells: DataFrame
    sketches: DataFrame


def rank_error(k: int) -> float:
    """The published bound of a KLL sketch's rank error for a single quantile, at 99 % confidence."""
    return 2.296 / k**0.9723


def report_states(results: DataFrame, day: Column, k: int = SKETCH_SIZE) -> States:
    """The states of result rows; `day` is the date that a row belongs to."""
    turns = reports.turns_column(results)
    rows = results.select(
        "batch_id",
        day.alias("day"),
        "scenario",
        "status",
        F.col("score").cast("int").alias(_SCORE),
        (F.col(turns) if turns else F.lit(None)).cast("int").alias(_TURNS),
        F.col("duration_seconds").cast("double").alias("_d"),
    )
    cells = rows.groupBy(*_CELL).agg(
        F.count("*").alias("n"),
        F.count("_d").alias("duration_n"),
        F.sum("_d").alias("duration_sum"),
        F.min("_d").alias("duration_min"),
        F.max("_d").alias("duration_max"),
    )
    timed = rows.filter(F.col("_d").isNotNull()).groupBy("batch_id", "day")
    return States(cells, timed.agg(F.kll_sketch_agg_double("_d", F.lit(k)).alias("durations")))


def write_states(states: States, path: str) -> None:
    """Store states in `day=...` folders; days that are there already are replaced, others stay."""
    for name, table in zip(States._fields, states):
        writer = table.hint("rebalance", "day").write.partitionBy("day").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def read_states(spark: SparkSession, path: str, days: Column | None = None) -> States:
    """Stored states; `days` is a condition on the column `day`, and prunes folders."""
    tables = []
    for name, schema in zip(States._fields, (CELLS, SKETCHES)):
        table = spark.read.schema(schema).parquet(f"{path}/{name}")
        tables.append(table if days is None else table.filter(days))
    return States(*tables)


def merge_states(*states: States) -> States:
    """The states of all results that any of these were made of; no result may be in two of them."""
    cells, sketches = states[0]
    for more in states[1:]:
        cells, sketches = cells.unionByName(more.cells), sketches.unionByName(more.sketches)
    return States(
        cells.groupBy(*_CELL).agg(*[add(name).alias(name) for name, add in _SUMS.items()]),
        sketches.groupBy("batch_id", "day").agg(F.kll_merge_agg_double("durations").alias("durations")),
    )


def _counted(value: str, when: Column | None = None) -> Column:
    """Rows that have a value."""
    there = F.col(value).isNotNull() if when is None else when
    return F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0))


def _total(value: str) -> Column:
    return F.sum(F.col(value).cast("bigint") * F.col("n"))


def _mean(value: str) -> Column:
    return _total(value) / F.nullif(_counted(value), F.lit(0))


def _zero(value: Column, kind: str = "double") -> Column:
    return F.coalesce(value.cast(kind), F.lit(0).cast(kind))


def _median(value: str) -> Column:
    """The interpolated median; cells without the value do not count."""
    return _zero(F.percentile(value, 0.5, F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0)))


def report_from_states(states: States, batches: DataFrame | None = None) -> DataFrame:
    """`reports.summary_report` of all results in the states, its median of durations from sketches."""
    n = F.sum("n")
    completed = _counted("status", F.col("status") == "completed")
    scored = _counted(_SCORE)
    squares = F.sum(F.col(_SCORE).cast("bigint") * F.col(_SCORE) * F.col("n")).cast("double")
    total = _total(_SCORE).cast("double")
    spread = F.sqrt(F.greatest((squares - total * total / scored) / (scored - 1), F.lit(0.0)))
    stats = states.cells.groupBy("batch_id").agg(
        n.alias("total_scenarios"),
        completed.alias("successful_scenarios"),
        _counted("status", F.col("status") == "failed").alias("failed_scenarios"),
        numbers.ratio_or_zero(completed, n).alias("success_rate"),
        _zero(_mean(_SCORE)).alias("score_mean"),
        F.when(scored == 0, 0.0).when(scored > 1, spread).alias("score_std"),
        _zero(F.min(_SCORE), "int").alias("score_min"),
        _zero(F.max(_SCORE), "int").alias("score_max"),
        _median(_SCORE).alias("score_median"),
        *[_counted(_SCORE, F.col(_SCORE) == s).alias(f"score_{s}") for s in c.VALID_SCORES],
        _zero(_mean(_TURNS)).alias("turns_mean"),
        _zero(F.min(_TURNS), "int").alias("turns_min"),
        _zero(F.max(_TURNS), "int").alias("turns_max"),
        _median(_TURNS).alias("turns_median"),
        _zero(F.sum("duration_sum") / F.nullif(F.sum("duration_n"), F.lit(0))).alias("duration_mean"),
        _zero(F.min("duration_min")).alias("duration_min"),
        _zero(F.max("duration_max")).alias("duration_max"),
        _zero(F.sum("duration_sum")).alias("duration_total"),
    )
    merged = states.sketches.groupBy("batch_id").agg(F.kll_merge_agg_double("durations").alias("_s"))
    middle = merged.select(
        "batch_id", F.kll_sketch_get_quantile_double("_s", F.lit(0.5)).alias("duration_median")
    )
    stats = stats.join(middle, "batch_id", "left").withColumn("duration_median", _zero(F.col("duration_median")))
    named = states.cells.filter(F.col("scenario").isNotNull()).groupBy("batch_id", "scenario")
    figures = named.agg(
        _counted(_SCORE).alias("score_count"),
        numbers.round_half_even(_mean(_SCORE), 2).alias("score_mean"),
        numbers.round_half_even(F.sum("duration_sum") / F.nullif(F.sum("duration_n"), F.lit(0)), 2).alias("duration_seconds_mean"),
        numbers.round_half_even(_mean(_TURNS), 2).alias("total_turns_mean"),
    )
    entry = F.struct("scenario", "score_count", "score_mean", "duration_seconds_mean", "total_turns_mean")
    nested = figures.groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("scenario_performance"))
    return reports.nested_report(stats, nested, batches)
