"""Round trips through files, with awkward cells."""

import json
import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from talkgauge import schemas
from talkgauge.operators import results as rows
from talkgauge.plans import reports
from talkgauge.sources import logs, results as files, sinks

AWKWARD = ['say "hi", ok', "back\\slash", "two\r\nlines", "Привет, мир", None, "", "a,b", "'quoted'"]


def at():
    return F.lit("2025-06-08T10:00:00")


@pytest.fixture
def results(spark):
    data = [
        (
            f"b{i % 2}", None, i, "sc" if i else None, f"s{i}", None, "completed" if i else "failed",
            None, i, i / 8, 1 + i % 3, comment, "success", datetime(2025, 6, 8, 10, 0, i, 123456 * (i % 2)), None,
        )
        for i, comment in enumerate(AWKWARD)
    ]
    return spark.createDataFrame(data, schemas.RESULT)


def test_ndjson_round_trip(spark, results, tmp_path):
    path = str(tmp_path / "r.ndjson")
    sinks.write_results_ndjson(results, path, at(), batch_id="other")
    back = files.load_results(spark, path)
    keep = [c for c in results.columns if c != "export_timestamp"]
    assert sorted(map(repr, back.select(keep).collect())) == sorted(map(repr, results.select(keep).collect()))
    assert back.select("export_timestamp").distinct().collect() == [("2025-06-08T10:00:00",)]


def test_ndjson_bad_line_fails_and_blank_lines_are_skipped(spark, tmp_path):
    good = tmp_path / "good.ndjson"
    good.write_text('{"session_id":"a","score":2}\n\n   \n{"session_id":"b"}\n', "utf-8")
    assert files.load_results(spark, str(good)).count() == 2
    bad = tmp_path / "bad.ndjson"
    bad.write_text('{"session_id":"a"}\n{oops\n', "utf-8")
    with pytest.raises(Exception):
        files.load_results(spark, str(bad)).collect()


def test_explicit_nulls_can_be_kept(spark, results, tmp_path):
    sinks.write_results_ndjson(results, str(tmp_path / "n"), at(), keep_nulls=True)
    lines = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "n"))
    assert lines.filter(F.col("value").contains('"comment":null')).count() == 1


def test_csv_round_trip(spark, results, tmp_path):
    path = str(tmp_path / "r.csv")
    assert sinks.write_results_csv(results, path, "v1")
    back = {r.session_id: r for r in files.load_results(spark, path).collect()}
    clean = [None if not c else c.replace("\n", " ").replace("\r", " ") for c in AWKWARD]
    assert [back[f"s{i}"].comment for i in range(len(AWKWARD))] == clean
    assert back["s0"].scenario is None and back["s0"].prompt_version == "v1"
    assert back["s3"].total_turns == 3 and back["s3"].duration_seconds == 0.375
    assert back["s1"].start_time == datetime(2025, 6, 8, 10, 0, 1, 123456)


def test_nothing_is_written_for_no_rows(spark, results, tmp_path):
    none = results.filter("false")
    assert not sinks.write_results_csv(none, str(tmp_path / "r.csv"))
    assert not sinks.write_summary_csv(none, str(tmp_path / "s.csv"))
    assert not os.path.exists(tmp_path / "r.csv") and not os.path.exists(tmp_path / "s.csv")


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="Unsupported file format: x.txt"):
        files.load_results(spark, "x.txt")


def test_summary_columns_are_those_that_exist(results):
    assert rows.summary_columns(results.drop("score")).columns == [
        "session_id", "scenario", "total_turns", "duration_seconds", "status",
    ]


def document(path):
    """The text of a document folder, its files in name order."""
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return "".join(open(os.path.join(path, p), encoding="utf-8").read() for p in parts)


def test_result_envelope_is_one_json_document_per_batch(spark, results, tmp_path):
    batches = spark.createDataFrame([("b0",), ("b1",), ("none",)], "batch_id string")
    sinks.write_document(reports.results_envelope(results.repartition(5), batches), str(tmp_path / "e"))
    assert json.loads(document(tmp_path / "e" / "batch_id=none")) == {
        "batch_id": "none", "results": [], "total_results": 0,
    }
    for batch in ("b0", "b1"):
        doc = json.loads(document(tmp_path / "e" / f"batch_id={batch}"))
        want = [i for i in range(len(AWKWARD)) if f"b{i % 2}" == batch]
        assert (doc["batch_id"], doc["total_results"]) == (batch, len(want))
        assert [r["scenario_index"] for r in doc["results"]] == want
        assert [r.get("comment") for r in doc["results"]] == [AWKWARD[i] for i in want]


def test_summary_document(spark, results, tmp_path):
    renamed = results.withColumn(
        "scenario", F.when(F.col("scenario_index") > 0, F.concat(F.lit('q"'), F.col("scenario_index") % 3))
    )
    jobs = spark.createDataFrame([("b0",), ("b1",), ("empty",)], "batch_id string")
    now = F.lit("2025-06-08 10:00:00").cast("timestamp_ntz")
    sinks.write_document(reports.summary_document(renamed, now, jobs), str(tmp_path / "d"))
    docs = {b: json.loads(document(tmp_path / "d" / f"batch_id={b}")) for b in ("b0", "b1", "empty")}
    assert docs["empty"] == {
        "batch_id": "empty", "total_scenarios": 0, "summary_stats": {}, "generated_at": "2025-06-08T10:00:00",
    }
    b1 = docs["b1"]
    assert b1["total_scenarios"] == 4 and b1["success_rate"] == 1.0
    assert b1["score_statistics"]["mean"] == 2.0 and b1["turn_statistics"]["median"] == 4.0
    assert b1["duration_statistics"]["total"] == 2.0
    assert set(b1["scenario_performance"]) == {'q"0', 'q"1', 'q"2'}
    assert b1["scenario_performance"]['q"1'] == {
        "score_count": 2, "score_mean": 2.0, "duration_seconds_mean": 0.5, "total_turns_mean": 4.0,
    }


TOKEN_LINES = """2025-06-08 10:00:00,123 - {"session_id":"a - b","model":"m","prompt_tokens":1,"completion_tokens":2,"total_tokens":3,"cost_estimate":0.00123,"timestamp":"2025-06-08T10:00:00.123456"}

2025-06-08 10:00:01,000 - {"session_id":"c"}
2025-06-08 10:00:02,000 - {broken
no separator
2025-06-08 10:00:03,000 - {"total_tokens":5} tail
2025-06-08 10:00:04,000 - [1]
"""


def test_token_log(spark, tmp_path):
    (tmp_path / "tokens_1.log").write_text(TOKEN_LINES, "utf-8")
    (tmp_path / "app_1.log").write_text(TOKEN_LINES, "utf-8")
    out = {r.session_id: r for r in logs.read_token_log(spark, str(tmp_path)).collect()}
    assert set(out) == {"a - b", "c"}
    assert (out["a - b"].total_tokens, out["a - b"].cost_estimate) == (3, Decimal("0.0012300000"))
    assert (out["c"].total_tokens, out["c"].cost_estimate, out["c"].model) == (0, Decimal("0E-10"), None)


def test_conversation_log(spark, tmp_path):
    lines = [
        {"session_id": "s", "turn_number": 1, "role": "agent", "content": "Здравствуйте", "tool_calls": None, "timestamp": "2025-06-08T10:00:00.000001"},
        {"session_id": "s", "turn_number": 1, "role": "client", "content": "Да", "timestamp": "2025-06-08T10:00:05"},
        {"session_id": "s", "total_turns": 1, "final_score": None, "status": "completed", "timestamp": "2025-06-08T10:00:06", "event_type": "conversation_complete"},
    ]
    (tmp_path / "conversations_1.jsonl").write_text("\n".join(json.dumps(x) for x in lines), "utf-8")
    turns, completions = logs.read_conversation_log(spark, str(tmp_path))
    messages = sorted(logs.messages_from_log(turns).collect(), key=lambda r: r.msg_index)
    assert [(m.msg_index, m.speaker, m.content) for m in messages] == [(0, "agent", "Здравствуйте"), (1, "client", "Да")]
    assert completions.first().total_turns == 1 and completions.count() == 1


def test_service_log(spark, tmp_path):
    (tmp_path / "e.log").write_text(
        "2025-06-08 10:00:00,123 - app - INFO - started\n"
        '2025-06-08 10:00:01,000 - app_error - ERROR - request failed (attempt 2/3) - {"session_id": "x - y"}\n'
        "Traceback (most recent call last):\n  File x\nValueError: no\n",
        "utf-8",
    )
    log = logs.read_service_log(spark, str(tmp_path / "e.log"))
    error = log.filter("level = 'ERROR'").first()
    assert (error.message, error.extra) == ("request failed (attempt 2/3)", '{"session_id": "x - y"}')
    assert (error.attempt, error.attempts) == (2, 3)
    assert {r.level: (r.n, r.retries) for r in logs.count_levels(log).collect()} == {"INFO": (1, 0), "ERROR": (1, 1)}


def test_listing(spark, results, tmp_path):
    base = str(tmp_path / "out")
    for stamp in ("1", "2"):
        sinks.write_export(results, f"{base}/r.csv", "csv", stamp, at())
    listed = files.list_result_files(spark, base, "batch_id=b1")
    assert {r.filepath.split("/")[-3] for r in listed.collect()} == {"batch_id=b1"}
    latest = files.latest_export(files.list_result_files(spark, base)).collect()
    assert sorted(map(tuple, latest)) == [("b0", "csv", "2"), ("b1", "csv", "2")]
    assert files.list_result_files(spark, str(tmp_path / "missing")).collect() == []


def test_logs_for_batch_reads_only_its_folder(spark, tmp_path):
    df = spark.createDataFrame([("b1", "x"), ("b2", "y")], "batch_id string, value string")
    df.write.partitionBy("batch_id").text(str(tmp_path / "logs"))
    assert files.logs_for_batch(spark, str(tmp_path / "logs"), "b1").collect() == [("x",)]


def test_random_part_names_do_not_count(spark, tmp_path):
    spark.createDataFrame([("b1", "x"), ("b2", "y")], "batch_id string, value string").write.partitionBy(
        "batch_id"
    ).text(str(tmp_path / "logs"))
    for digit in "0123456789abcdef":  # single characters that random names are bound to contain
        found = files.list_result_files(spark, str(tmp_path / "logs"), digit).collect()
        folders = {r.filepath.split("/")[-2] for r in found}
        assert folders == {f for f in ("batch_id=b1", "batch_id=b2") if digit in f}


def test_appending_twice_keeps_both(spark, tmp_path):
    df = spark.createDataFrame([("s", datetime(2025, 6, 8, 10, 0))], "session_id string, timestamp timestamp_ntz")
    for _ in range(2):
        sinks.append_logs(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    assert os.path.isdir(tmp_path / "l" / "log_date=2025-06-08")
