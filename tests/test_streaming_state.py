"""Streams with state of their own: the clock of exchanges, upserts, request peaks, appended logs."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from talkgauge.operators import conversations
from talkgauge.sources.commits import Folder
from talkgauge.streaming import appends, rates, timeouts, upserts

BASE = datetime(2025, 6, 8, 10, 0, 0)
MESSAGES = "session_id string, msg_index bigint, speaker string, ts timestamp"


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def add_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- the clock of exchanges ----------------------------------------------------


def talk(name, start, gaps, first="agent"):
    """Alternating messages, `gaps` seconds apart."""
    rows, now = [], start
    for k, gap in enumerate([0, *gaps]):
        now += gap
        speaker = "agent" if (k % 2 == 0) == (first == "agent") else "client"
        rows.append((name, k, speaker, at(now)))
    return rows


def expected_cuts(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], MESSAGES + ", content string")
    kept = conversations.cut_at_timeout(table, "agent", 90)
    left = {r.session_id: r.n for r in kept.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    whole = Counter(r[0] for r in rows)
    return {s: left.get(s, 0) for s, n in whole.items() if left.get(s, 0) < n}


def test_clock_equals_cut_at_timeout_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    rows = talk("edge", 0, [90, 1, 1]) + talk("over", 3, [45, 46, 1, 1, 200]) + talk("one", 9, [])
    rows += talk("long_exchange", 5, [300]) + talk("system", 7, [10, 100, 5], first="client")
    for k in range(25):
        rows += talk(f"s{k}", rng.randrange(600), [rng.choice([1, 10, 30, 60, 100]) for _ in range(rng.randrange(9))])
    want = expected_cuts(spark, rows)
    assert {"over", "system"} <= set(want) and "edge" not in want and "long_exchange" not in want
    # in order of time, but shuffled within the delay, and some rows twice
    late = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.uniform(0, 590)))
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    third = len(late) // 3
    chunks = [late[:third], late[third : 2 * third] + late[third : third + 5], late[2 * third :]]

    def run():
        cuts = timeouts.stream_exchange_timeout(stream_of(spark, path, MESSAGES), "agent", "10 minutes", 90, 60)
        return timeouts.run_stateful(spark, cuts, out, checkpoint)

    def found():
        return sorted((r.session_id, r.cut_index) for r in spark.read.parquet(out).collect())

    for chunk in chunks:  # each run starts from the checkpoint of the one before
        add_file(spark, path, chunk, MESSAGES)
        run()
    early = found()
    assert len(early) == len(set(early)) and dict(early).items() <= want.items()
    # a row without a session moves the clock past all of them
    add_file(spark, path, [(None, None, None, at(100_000))], MESSAGES)
    query = run()
    assert found() == sorted(want.items())
    assert query.lastProgress.stateOperators[0].numRowsTotal == 0
    run()
    assert found() == sorted(want.items())


def test_clock_keeps_sessions_that_are_not_passed_yet(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    add_file(spark, path, talk("open", 0, [100, 100, 100]) + talk("now", 5_000, [1]), MESSAGES)
    cuts = timeouts.stream_exchange_timeout(stream_of(spark, path, MESSAGES), "agent", "2 hours", 90)
    timeouts.run_stateful(spark, cuts, out, checkpoint)
    assert spark.read.schema(cuts.schema).parquet(out).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != timeouts.ROCKSDB


# --- upserts -------------------------------------------------------------------

ROWS = StructType([StructField("name", StringType()), StructField("n", LongType())])


def test_upserts_write_what_changed(spark, tmp_path):
    log = upserts.UpsertLog(spark, str(tmp_path / "t"), ROWS, ["name"])
    many = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("name"), F.col("id").alias("n"))
    assert log.write(many, 0)
    before = Folder(spark, str(tmp_path / "t")).files("data")
    few = spark.createDataFrame([(f"k{k}", -k) for k in range(10)], ROWS)
    assert log.write(few, 1)
    after = Folder(spark, str(tmp_path / "t")).files("data")
    new = {f: n for f, n in after.items() if f not in before}
    assert set(before) <= set(after) and len(new) <= 10
    written = spark.read.option("recursiveFileLookup", True).parquet(*[f"{tmp_path}/t/data/{f}" for f in new])
    assert written.count() == 10
    assert sum(new.values()) < sum(before.values()) / 20
    table = log.read()
    assert table.count() == 100_000 and table.where("n < 0").count() == 9
    # a repeated epoch changes nothing, with whatever rows
    assert not log.write(many, 1) and not log.write(few, 0)
    assert Folder(spark, str(tmp_path / "t")).files("data") == after


def test_upserts_equal_a_dictionary_and_keep_few_layers(spark, tmp_path):
    rng, want = random.Random(2), {}
    log = upserts.UpsertLog(spark, str(tmp_path / "t"), ROWS, ["name"], buckets=2)
    for epoch in range(14):
        changed = {rng.choice([None, *map(str, range(40))]): rng.randrange(100) for _ in range(8)}
        if epoch == 6:
            changed = {}
        want |= changed
        assert log.write(spark.createDataFrame(list(changed.items()), ROWS), epoch)
    assert {r.name: r.n for r in log.read().collect()} == want
    layers = log.newest()["layers"]
    assert max(len(own) for own in layers.values()) <= 5
    for own in layers.values():
        assert all(below["rows"] >= 2 * above["rows"] for below, above in zip(own, own[1:]))
    kept = Folder(spark, str(tmp_path / "t")).names("data")
    gone = log.remove_unused(keep=1)
    assert gone and set(gone) < set(kept)
    assert {r.name: r.n for r in log.read().collect()} == want


def test_upserts_without_a_commit_leave_no_trace_and_lost_data_raises(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    log = upserts.UpsertLog(spark, path, ROWS, ["name"])
    assert log.read().collect() == []
    assert log.write(spark.createDataFrame([("a", 1)], ROWS), 0)
    with monkeypatch.context() as m:
        m.setattr(Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            log.write(spark.createDataFrame([("a", 2)], ROWS), 1)
    assert [tuple(r) for r in log.read().collect()] == [("a", 1)]
    assert log.write(spark.createDataFrame([("a", 3)], ROWS), 1)
    assert [tuple(r) for r in log.read().collect()] == [("a", 3)]
    with pytest.raises(ValueError):
        upserts.UpsertLog(spark, path, ROWS, ["name"], buckets=3).read()
    folder = Folder(spark, path)
    folder.remove("data/" + log.newest()["layers"].popitem()[1][-1]["files"][0].split("/")[1])
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        log.read().collect()
    folder.remove("commits")
    with pytest.raises(FileNotFoundError):
        log.write(spark.createDataFrame([("a", 4)], ROWS), 2)


def test_commit_records_are_written_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "c"))
    assert folder.names() == [] and folder.create("x/1.json", {"a": "ä"})
    assert not folder.create("x/1.json", {"a": 2}) and folder.read("x/1.json") == {"a": "ä"}
    assert folder.names("x") == ["1.json"] or [n for n in folder.names("x") if not n.startswith(".")] == ["1.json"]


# --- request peaks -------------------------------------------------------------


def brute_peaks(times, limit):
    found = {}
    for t in times:
        rate = sum(t - timedelta(seconds=1) < u <= t for u in times)
        own = found.setdefault(t.replace(microsecond=0), [0, 0, 0])
        own[0] += 1
        own[1] = max(own[1], rate)
        own[2] += rate > limit
    return {s: (n, peak, busy, peak > limit) for s, (n, peak, busy) in found.items()}


def arrivals():
    rng = random.Random(4)
    times = [at(rng.choice([0, 1, 2, 5, 700, 701, 1500]) + rng.random().__round__(2)) for _ in range(300)]
    return times + [at(0.5)] * 40  # many of one instant


def test_peaks_equal_brute_force(spark):
    times = arrivals()
    table = spark.createDataFrame([(t,) for t in [*times, None]], "ts timestamp_ntz")
    got = {r.second: (r.requests, r.peak, r.busy_requests, r.over_limit) for r in rates.request_peaks(table, limit=30).collect()}
    assert got == brute_peaks(times, 30)


def test_a_burst_over_two_calendar_seconds_is_flagged(spark):
    times = [at(0.9 + k / 100) for k in range(20)]  # ten in each second
    table = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    got = {r.second: r.over_limit for r in rates.request_peaks(table, limit=15).collect()}
    assert got == {at(0): False, at(1): True}
    calm = spark.createDataFrame([(at(0.0),), (at(1.0),)], "ts timestamp")
    assert [r.peak for r in rates.request_peaks(calm, limit=1).collect()] == [1, 1]  # exactly a second apart


def test_streamed_rates_equal_the_table(spark, tmp_path):
    times = sorted(arrivals())
    path = str(tmp_path / "in")
    for k in range(0, len(times), 100):
        add_file(spark, path, [(t,) for t in times[k : k + 100]], "ts timestamp")
    closed = max(times) - timedelta(seconds=600)
    whole = brute_peaks(times, 30)
    out = rates.run_request_peaks(
        spark, stream_of(spark, path, "ts timestamp"), str(tmp_path / "out"), str(tmp_path / "cp"), limit=30
    )
    got = {r.second: (r.requests, r.peak, r.busy_requests, r.over_limit) for r in out.collect()}
    last = max(times).replace(microsecond=0) + timedelta(seconds=1) - timedelta(seconds=600)
    assert got == {s: v for s, v in whole.items() if s <= last}
    rated = rates.stream_request_rate(stream_of(spark, path, "ts timestamp"), limit=30)
    from talkgauge.streaming import jobs

    rows = jobs.run_available(rated, str(tmp_path / "out2"), str(tmp_path / "cp2")).collect()
    want = Counter(t.replace(microsecond=0) for t in times)
    assert {r.second: (r.requests, r.over_limit) for r in rows} == {
        s: (n, n > 30) for s, n in want.items() if s + timedelta(seconds=1) <= closed
    }


# --- appended logs -------------------------------------------------------------


def test_appended_logs_are_written_once(spark, tmp_path, monkeypatch):
    schema = "session_id string, total_tokens bigint, timestamp timestamp_ntz"
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    days = [datetime(2025, 1, d, 23, 59, 59, 5) for d in (1, 2, 3)]
    add_file(spark, path, [(f"s{k}", k, days[k % 2]) for k in range(20)], schema)
    appends.start_append_logs(stream_of(spark, path, schema), out, checkpoint).awaitTermination()
    kind = spark.read.parquet(path).schema
    assert appends.read_appended_logs(spark, out, kind).count() == 20

    add_file(spark, path, [(f"t{k}", k, days[k % 3]) for k in range(30)] + [("none", 1, None)], schema)
    from pyspark.sql.readwriter import DataFrameWriter

    written = DataFrameWriter.json

    def written_then_cut_off(self, *args, **kwargs):
        written(self, *args, **kwargs)
        raise RuntimeError("cut off before the commit")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", written_then_cut_off)
        with pytest.raises(Exception, match="cut off"):
            appends.start_append_logs(stream_of(spark, path, schema), out, checkpoint).awaitTermination()
    # what was written may be read, and is not there twice after the rerun
    assert appends.read_appended_logs(spark, out, kind).count() == 51
    appends.start_append_logs(stream_of(spark, path, schema), out, checkpoint).awaitTermination()
    rows = appends.read_appended_logs(spark, out, kind)
    assert sorted(r.session_id for r in rows.collect()) == sorted([f"s{k}" for k in range(20)] + [f"t{k}" for k in range(30)] + ["none"])
    assert rows.where("log_date = '2025-01-03'").count() == 10
    assert rows.where("session_id = 't2'").first().timestamp == days[2]
    # any other reader sees each record once, too
    assert spark.read.option("recursiveFileLookup", True).text(out).count() == 51
