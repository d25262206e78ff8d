"""Conversation logs, as files, to a report in one piece."""

from datetime import datetime, timedelta

from talkgauge.plans import reports
from talkgauge.sources import logs, sinks

BASE = datetime(2025, 1, 1, 9)


def at(n):
    return BASE + timedelta(seconds=n)


def test_report_from_logs(spark, tmp_path):
    turns = [
        ("a", 1, "agent", "hello", at(0)), ("a", 1, "client", "hi", at(10)), ("a", 2, "agent", "END_CALL now", at(25)), ("a", 2, "client", "after", at(40)),
        ("b", 1, "agent", "one", at(0)), ("b", 1, "client", "two", at(5)), ("b", 1, "client", "logged twice", at(6)),
        ("late", 1, "agent", "no record", at(3)),
    ]
    done = [("a", 3, "good", "completed", at(50)), ("b", 2, "old", "running", at(60)), ("b", 1, "bad", "failed", at(61)), ("none", 1, "lost", "failed", at(62))]
    turn_rows = spark.createDataFrame(turns, "session_id string, turn_number int, role string, content string, timestamp timestamp_ntz")
    done_rows = spark.createDataFrame([(*d, "conversation_complete") for d in done], "session_id string, final_score int, evaluator_comment string, status string, timestamp timestamp_ntz, event_type string")
    path = str(tmp_path / "logs")
    sinks.append_logs(turn_rows, path)
    sinks.append_logs(done_rows, path)
    read = logs.read_conversation_log(spark, path)
    row = reports.report_from_logs(*read).first()
    assert (row.batch_id, row.total_scenarios, row.successful_scenarios, row.failed_scenarios) == ("logs", 4, 1, 2)
    assert (row.score_statistics.mean, row.score_statistics.median) == (5 / 3, 1.0)
    assert (row.turn_statistics.max, row.turn_statistics.mean) == (2, 4 / 3)
    assert (row.duration_statistics.total, row.duration_statistics.max) == (30.0, 25.0)  # a: cut at 25, b: 5, late: 0
    batches = spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "none")], "batch_id string, session_id string")
    found = {r.batch_id: r.total_scenarios for r in reports.report_from_logs(*read, batches=batches).collect()}
    assert found == {"x": 1, "y": 2, None: 1}
    one = reports.report_from_logs(*read, max_turns=1).first()
    assert one.turn_statistics.max == 1
