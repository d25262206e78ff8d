"""Streams against their batch twins, over several input files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkgauge.plans import reports
from talkgauge.streaming import jobs as streams

BASE = datetime(2025, 6, 8, 10, 0, 0)


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Three files of usage, in time order, with one row that comes much too late."""
    path = str(tmp_path_factory.mktemp("usage"))
    rows = [
        (BASE + timedelta(seconds=20 * i), f"m{i % 2}", i, "batch-%d" % (i % 3), "completed" if i % 4 else "failed")
        for i in range(300)
    ]
    late = (BASE + timedelta(seconds=30), "m0", 1_000_000, "batch-0", "completed")
    schema = "ts timestamp, model string, total_tokens bigint, batch_id string, status string"
    for chunk in (rows[:100], rows[100:200], [*rows[200:], late]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream_of(spark, path):
    schema = spark.read.parquet(path).schema
    # one file per micro-batch, oldest first
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_token_usage_drops_late_rows_and_equals_batch(spark, arrivals, tmp_path):
    path, rows = arrivals
    source = stream_of(spark, path).withColumn("cost_estimate", F.lit("0.5").cast("decimal(18,10)"))
    usage = streams.stream_token_usage(source)
    out = streams.run_available(usage, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.window_start, r.model): (r.requests, r.tokens) for r in out.collect()}
    closed = max(r[0] for r in rows) - timedelta(minutes=10)
    want = {}
    for ts, model, tokens, *_ in rows:
        start = ts.replace(second=0)
        if start + timedelta(minutes=1) <= closed:
            n, t = want.get((start, model), (0, 0))
            want[start, model] = (n + 1, t + tokens)
    assert got == want


def test_progress_equals_batch(spark, arrivals, tmp_path):
    path, _ = arrivals
    progress = streams.stream_batch_progress(stream_of(spark, path))
    out = streams.run_upserts(spark, progress, ["batch_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    twin = streams.stream_batch_progress(spark.read.parquet(path))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, twin.collect()))


def test_timeouts_over_several_batches(spark, tmp_path):
    seconds = lambda n: BASE + timedelta(seconds=n)
    files = [
        [("in_time", 0, False), ("never", 5, False), ("edge", 10, False), ("in_time", 60, True)],
        [("edge", 100, True), ("too_late", 20, False), ("too_late", 111, True), ("open", 3000, False)],
        [("clock", 1500, False), ("clock", 1510, True), ("other", 3500, False), ("other", 3501, True)],
    ]
    path = str(tmp_path / "in")
    schema = "session_id string, ts timestamp, completed boolean"
    for chunk in files:
        data = [(s, seconds(n), done) for s, n, done in chunk]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    starts = stream_of(spark, path).filter(~F.col("completed"))
    done = stream_of(spark, path).filter("completed")
    late = streams.stream_conversation_timeout(starts, done)
    out = streams.run_available(late, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.session_id: r.deadline for r in out.collect()}
    # 'open' starts within the last ten minutes of what has arrived, so it is not decided yet
    assert got == {"never": seconds(95), "too_late": seconds(110)}


def test_request_rate_flags_busy_seconds(spark):
    df = spark.createDataFrame(
        [(BASE + timedelta(milliseconds=m),) for m in [0, 10, 999, 1000, 2500]], "ts timestamp_ntz"
    )
    got = {r.second: (r.requests, r.over_limit) for r in reports.request_rate(df, limit=2).collect()}
    assert got == {
        BASE: (3, True), BASE + timedelta(seconds=1): (1, False), BASE + timedelta(seconds=2): (1, False),
    }
