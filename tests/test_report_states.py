"""Stored states against the one-pass report, in any grouping; the rank error of their sketches."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from talkgauge.plans import reports, states

SCHEMA = (
    "batch_id string, scenario string, status string, score int, total_turns int, duration_seconds double, day date"
)


def rows_of(rng, n):
    for k in range(n):
        yield (
            rng.choice(["hot", "hot", "b1", "b2", None]),
            rng.choice([None, "s1", "s2", "s3"]),
            rng.choice(["completed", "failed", "running", None]),
            rng.choice([None, 1, 2, 3, 3]),
            rng.choice([None, 1, 2, 5, 30]),
            rng.choice([None, rng.randrange(4000) / 8]),
            date(2025, 1, 1 + k % 4),
        )


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(list(rows_of(random.Random(1), 3000)), SCHEMA).cache()


def plain(report):
    """Rows without the medians of durations."""
    flat = report.withColumn("duration_statistics", F.col("duration_statistics").dropFields("median"))
    return sorted((r.asDict(recursive=True) for r in flat.collect()), key=repr)


def median_of(report):
    return {r.batch_id: r.duration_statistics.median for r in report.collect()}


def test_states_in_any_grouping_equal_the_report(spark, results):
    whole = states.report_states(results, F.col("day"))
    parts = [states.report_states(results.where(F.dayofmonth("day") == d), F.col("day")) for d in (1, 2, 3, 4)]
    by_row = [states.report_states(results.where(F.pmod(F.xxhash64(*results.columns), F.lit(3)) == k), F.col("day")) for k in range(3)]
    want = plain(reports.summary_report(results))
    for merged in (whole, states.merge_states(*parts), states.merge_states(states.merge_states(*by_row[:2]), by_row[2])):
        assert plain(states.report_from_states(merged)) == want


def test_stored_days_are_replaced_and_pruned(spark, results, tmp_path):
    path = str(tmp_path / "states")
    states.write_states(states.report_states(results, F.col("day")), path)
    again = results.where("day = '2025-01-02'")
    states.write_states(states.report_states(again, F.col("day")), path)  # a day computed once more
    assert plain(states.report_from_states(states.read_states(spark, path))) == plain(reports.summary_report(results))
    late = states.read_states(spark, path, F.col("day") > "2025-01-02")
    assert plain(states.report_from_states(late)) == plain(reports.summary_report(results.where("day > '2025-01-02'")))
    plan = late.cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_rank_error_is_within_its_bound(spark):
    k = 200
    rng = random.Random(7)
    rows = [("hot" if n % 4 else f"b{n % 20}", rng.paretovariate(0.5), n % 16) for n in range(80_000)]
    frame = spark.createDataFrame(rows, "batch_id string, duration_seconds double, d int").selectExpr(
        "batch_id", "'s' AS scenario", "'completed' AS status", "3 AS score", "2 AS total_turns", "duration_seconds", "date_add(DATE'2025-01-01', d) AS day"
    )
    days = [states.report_states(frame.where(F.dayofmonth("day") % 4 == m), F.col("day"), k) for m in range(4)]
    merged = states.merge_states(*days)
    got = median_of(states.report_from_states(merged))
    exact = {r.batch_id: r.duration_median for r in reports.duration_stats(frame).collect()}
    for batch in exact:
        own = sorted(d for b, d, _ in rows if b == batch)
        below = sum(d < got[batch] for d in own) / len(own)
        assert abs(below - 0.5) <= states.rank_error(k) + 1 / len(own)
    # what is stored does not grow with the results
    assert merged.sketches.agg(F.max(F.octet_length("durations"))).first()[0] < 64 * k
    assert merged.cells.count() == frame.select("batch_id", "day").distinct().count()


def test_no_results(spark, results):
    none = results.where("false")
    made = states.report_states(none, F.col("day"))
    assert states.report_from_states(made).count() == 0
    batches = spark.createDataFrame([("idle",)], "batch_id string")
    assert plain(states.report_from_states(made, batches)) == plain(reports.summary_report(none, batches))
