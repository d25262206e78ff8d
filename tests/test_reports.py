"""Golden figures and invariants of the reports."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkgauge.operators import catalog, costs, results as rows
from talkgauge.plans import reports

BASE = datetime(2025, 6, 8, 10, 0, 0)
SCHEMA = (
    "batch_id string, scenario string, session_id string, status string, score int, total_turns int,"
    " duration_seconds double, start_time timestamp_ntz, end_time timestamp_ntz"
)


def row(score=2, batch="b", scenario="s", session="x", status="completed", turns=3, duration=1.5, start=0, end=1):
    return (
        batch, scenario, session, status, score, turns, duration,
        BASE + timedelta(seconds=start), BASE + timedelta(seconds=end),
    )


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_golden_score_statistics(spark):
    df = frame(spark, *[row(s) for s in [1, 2, 2, 2, 2, 2, 3, 3, 3, 3]])
    got = reports.score_stats(df).first()
    assert (got.score_mean, got.score_median, round(got.score_std, 1)) == (2.3, 2.0, 0.7)
    assert (got.score_min, got.score_max) == (1, 3)
    dist = reports.score_distribution(df).first()
    assert (dist.score_1, dist.score_2, dist.score_3, dist.score_2_pct) == (1, 5, 4, 50.0)


def test_statistics_agree_with_pandas_and_do_not_depend_on_partitions(spark):
    data = [row((i * 7) % 3 + 1, f"b{i % 3 and 1}", turns=i % 11, duration=i * 1.25) for i in range(300)]
    df = frame(spark, *data)
    pdf = pd.DataFrame([(r[0], r[4], r[5], r[6]) for r in data], columns=["b", "score", "turns", "duration"])
    one = {r.batch_id: r for r in reports.summary_report(df).collect()}
    many = {r.batch_id: r for r in reports.summary_report(df.repartition(17)).collect()}
    assert one == many
    for batch, group in pdf.groupby("b"):
        got = one[batch]
        assert got.total_scenarios == len(group)
        assert got.score_statistics["mean"] == pytest.approx(group.score.mean(), abs=1e-12)
        assert got.score_statistics["std"] == pytest.approx(group.score.std(), abs=1e-12)
        assert got.score_statistics["median"] == group.score.median()
        assert got.turn_statistics["median"] == group.turns.median()
        assert got.duration_statistics["median"] == group.duration.median()
        assert got.duration_statistics["total"] == group.duration.sum()


def test_single_score_has_no_deviation_and_no_scores_give_zeros(spark):
    assert reports.score_stats(frame(spark, row(2))).first().score_std is None
    got = reports.score_stats(frame(spark, row(None))).first()
    assert (got.score_mean, got.score_std, got.score_median, got.score_min) == (0.0, 0.0, 0.0, 0)
    got = reports.duration_stats(frame(spark, row(duration=None))).first()
    assert (got.duration_mean, got.duration_median, got.duration_total) == (0.0, 0.0, 0.0)


def test_distribution_is_zero_filled_and_sums_to_valid_scores(spark):
    got = reports.score_distribution(frame(spark, row(1), row(0), row(7), row(None))).first()
    assert (got.score_1, got.score_2, got.score_3) == (1, 0, 0)


def test_status_outside_the_two_is_in_neither_count(spark):
    got = reports.batch_counts(frame(spark, row(), row(status="failed"), row(status="running"))).first()
    assert (got.total_scenarios, got.successful_scenarios, got.failed_scenarios) == (3, 1, 1)
    assert got.success_rate == 1 / 3


def test_two_definitions_of_failed(spark):
    df = frame(spark, row(), row(status="failed"), row(status="failed", session=None))
    assert reports.batch_counts(df).first().failed_scenarios == 2
    got = reports.run_outcome(df).first()
    assert (got.successful_scenarios, got.failed_scenarios) == (2, 1)


def test_scenario_means_round_half_to_even(spark):
    df = frame(spark, row(1, duration=0.125), row(2, scenario=None), row(1, scenario="t", duration=0.375))
    got = {r.scenario: r.duration_seconds_mean for r in reports.scenario_performance(df).collect()}
    assert got == {"s": 0.12, "t": 0.38}


def test_csv_name_of_the_turns_column(spark):
    df = frame(spark, row(turns=4), row(turns=8)).withColumnRenamed("total_turns", "turns")
    assert reports.turn_stats(df).first().turns_median == 6.0
    assert reports.turn_stats(df.drop("turns")).first().turns_max == 0
    assert reports.summary_report(df.drop("turns")).first().turn_statistics["median"] == 0.0
    assert "turns_mean" in reports.scenario_performance(df).columns


def test_histogram_leaves_out_zero_and_null(spark):
    df = frame(spark, row(0), row(None), row(1), row(3), row(3), row(9))
    assert {r.bin: r.n for r in reports.score_histogram(df).collect()} == {1: 1, 3: 2}


def brute_peak(spans):
    return max(sum(1 for s, e in spans if s <= t < e) for t, _ in spans)


def test_peak_concurrency(spark):
    spans = {
        "b": [(0, 5), (1, 2), (2, 3), (4, 9), (4.5, 4.75)],
        "touching": [(0, 1), (1, 2), (2, 3)],
        "hours": [(k * 600, k * 600 + 5000) for k in range(40)],
        "hot": [((k * 37) % 500 / 8, (k * 37) % 500 / 8 + 1 + k % 5) for k in range(400)],
    }
    data = [row(batch=b, start=s, end=e) for b, ss in spans.items() for s, e in ss]
    got = {r.batch_id: (r.peak, r.over_limit) for r in reports.peak_concurrency(frame(spark, *data)).collect()}
    assert got == {b: (brute_peak(s), brute_peak(s) > 4) for b, s in spans.items()}


def test_determinism_check(spark):
    df = frame(spark, row(1, "b", "s"), row(2, "b", "s"), row(3, "b", "t"), row(3, "b", "t"))
    df = df.withColumn("seed", F.lit(1)).withColumn("prompt_version", F.lit("v"))
    assert [(r.scenario, r.runs) for r in reports.determinism_check(df).collect()] == [("s", 2)]


def test_expiry_is_strict(spark):
    day = 24 * 3600
    jobs = spark.createDataFrame(
        [("old", "failed", BASE - timedelta(seconds=day + 1)), ("edge", "completed", BASE - timedelta(seconds=day)),
         ("running", "running", BASE - timedelta(days=9)), ("open", "completed", None)],
        "batch_id string, status string, completed_at timestamp_ntz",
    )
    now = F.lit(BASE).cast("timestamp_ntz")
    assert [r.batch_id for r in rows.expired_batches(jobs, now).collect()] == ["old"]
    assert {r.batch_id for r in rows.kept_batches(jobs, now).collect()} == {"edge", "running", "open"}


def test_cost_of_batches_with_and_without_usage(spark):
    usage = spark.createDataFrame(
        [("a", "gpt-4o", 1000, 1000, 2000), ("a", "gpt-4o-mini", 1, 0, 1), ("b", "unknown", 5, 5, 10)],
        "session_id string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint",
    )
    costed = costs.request_cost(usage, costs.price_table(spark))
    results = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "session_id string, batch_id string")
    got = {r.batch_id: r for r in costs.cost_report(costed, results, results).collect()}
    assert float(got["x"].total_cost_usd) == 0.02 and got["x"].total_tokens == 2001
    assert got["x"].average_cost_per_request == 0.01
    assert (float(got["y"].total_cost_usd), got["y"].total_requests) == (0.0, 1)
    assert (got["z"].total_tokens, got["z"].total_requests, got["z"].average_cost_per_request) == (0, 0, 0.0)


def test_order_total_of_an_array(spark):
    df = spark.createDataFrame(
        [(1, [(10.0, 2.0), (None, 5.0), (3.5, None)]), (2, []), (3, None)],
        "id int, items array<struct<price:double,quantity:double>>",
    )
    got = {r.id: float(r.t) for r in df.select("id", catalog.order_total(F.col("items")).alias("t")).collect()}
    assert got == {1: 23.5, 2: 0.0, 3: 0.0}


MENU = [(0, "Филе курицы", "мясо"), (1, "пицца Маргарита", "пицца"), (2, "роллы филадельфия", "роллы"), (3, "ab", "x")]


@pytest.mark.parametrize("query", ["", "фил", "ФИЛЕ", "и", "цц", "пицца маргарита", "нет такого", "ab", "abc", "ил"])
@pytest.mark.parametrize("category", ["", "М", "роллы", "нет"])
def test_search_equals_substring_tests(spark, query, category):
    menu = spark.createDataFrame([(*m, 1.0) for m in MENU], "item_id bigint, name string, category string, price double")
    searches = spark.createDataFrame([(1, query, category)], "search_id int, query string, category string")
    matches = catalog.catalog_search(menu, searches)
    want = [i for i, n, k in MENU if query.lower() in n.lower() and category.lower() in k.lower()]
    assert sorted(r.position for r in matches.collect()) == want
    assert catalog.catalog_search_totals(matches, searches).first().total_found == len(want)


def test_customer_history(spark):
    customers = spark.createDataFrame([(1,), (2,)], "customer_id int")
    orders = spark.createDataFrame([(10, 1, BASE), (11, 1, BASE + timedelta(days=1))], "order_id int, customer_id int, order_date timestamp_ntz")
    items = spark.createDataFrame([(10, 5, 1.0), (11, 6, 3.0), (11, 7, 3.0), (11, 5, 1.0)], "order_id int, item_id int, quantity double")
    menu = spark.createDataFrame([(5, "five"), (6, "six"), (7, "seven")], "item_id int, name string")
    got = {r.customer_id: r for r in catalog.customer_history(customers, orders, items, menu).collect()}
    assert (got[1].status, got[1].previous_orders, got[1].favorite_item_1, got[1].favorite_item_2) == ("found", 2, "six", "seven")
    assert (got[2].status, got[2].previous_orders, got[2].favorite_item_1) == ("not_found", 0, None)


def test_new_session_ids_are_stable(spark):
    df = spark.createDataFrame([("b", 1, None), ("b", 2, ""), ("b", 3, "own")], "batch_id string, i int, session_id string")
    first = sorted(map(tuple, rows.assign_session_id(df, "batch_id", "i").collect()))
    again = sorted(map(tuple, rows.assign_session_id(df.repartition(3), "batch_id", "i").collect()))
    assert first == again and first[2][2] == "own" and len({r[2] for r in first}) == 3
    random_ids = [r.session_id for r in rows.assign_session_id(df).collect()]
    assert len(set(random_ids)) == 3 and all(random_ids)
