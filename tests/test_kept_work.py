"""Replies that outlive a killed run, CSV written in one job, documents with manifests."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from talkgauge.operators import evaluation
from talkgauge.plans import reports
from talkgauge.sources import documents, sinks
from talkgauge.sources.commits import Folder

CONVERSATIONS = "conversation_index bigint, session_id string, scenario string, transcript string"


def conversations_of(spark, n):
    rows = [(k, f"s{k}" if k % 7 else None, None, f"text {k}") for k in range(n)]
    return spark.createDataFrame(rows, CONVERSATIONS)


def recording(folder, die_on=None, wait_for=0):
    """A judge that leaves a file for each answer; it kills its worker on some texts, after others were answered."""

    def judge(text):
        number = int(text.split()[1])
        if die_on is not None and number >= die_on:
            until = time.time() + 60
            while len(os.listdir(folder)) < wait_for and time.time() < until:
                time.sleep(0.1)
            time.sleep(3)  # for the other tasks to end
            os._exit(1)
        with open(f"{folder}/{number}-{time.time_ns()}", "w"):
            pass
        if number % 5 == 0:
            raise ValueError(f"busy {number}")
        return '{"score": %d, "comment": "c%d"}' % (1 + number % 3, number)

    return judge


def asked(folder):
    return sorted(int(name.split("-")[0]) for name in os.listdir(folder))


def test_a_killed_run_asks_no_session_twice(spark, tmp_path, monkeypatch):
    n, half = 40, 20
    calls, store = str(tmp_path / "calls"), str(tmp_path / "replies")
    os.mkdir(calls)
    rows = conversations_of(spark, n).repartitionByRange(4, "conversation_index")
    # whole tasks of the first or the second half, so that the second half's tasks die and the first half's end
    kind = type(rows)
    by_half = kind.repartition

    def dealt(self, count, *keys):
        if keys[:1] != ("session_id",):
            return by_half(self, count, *keys)
        number = F.split("transcript", " ")[1].cast("int")
        return self.repartitionByRange(4, number)

    with monkeypatch.context() as m:
        m.setattr(kind, "repartition", dealt)
        with pytest.raises(Exception):
            evaluation.evaluate_stored(rows, recording(calls, half, half), store, "p", task_rows=10)
    assert asked(calls) == list(range(half))
    done = spark.sparkContext.accumulator(0)
    out = evaluation.evaluate_stored(rows, recording(calls), store, "p", answered=done).collect()
    assert asked(calls) == list(range(n)) and done.value == n - half
    plain = evaluation.evaluate_batch(rows, recording(calls)).collect()
    key = lambda r: r.conversation_index
    assert [r.asDict() for r in sorted(out, key=key)] == [r.asDict() for r in sorted(plain, key=key)]


def test_only_what_is_new_is_asked(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "replies")
    os.mkdir(calls)
    rows = conversations_of(spark, 12)
    evaluation.evaluate_stored(rows, recording(calls), store, "p")
    evaluation.evaluate_stored(rows, recording(calls), store, "p").collect()
    assert asked(calls) == list(range(12))
    evaluation.evaluate_stored(rows, recording(calls), store, "p", retry_failed=True)
    assert asked(calls) == sorted([*range(12), 0, 5, 10])
    more = rows.unionByName(rows).unionByName(conversations_of(spark, 14).where("conversation_index > 11"))
    out = evaluation.evaluate_stored(more, recording(calls), store, "p")
    assert out.count() == 26 and len(asked(calls)) == 15 + 2
    evaluation.evaluate_stored(rows.limit(0), recording(calls), store, "p").collect()
    changed = rows.where("conversation_index = 1").withColumn("transcript", F.lit("text 1 more"))
    evaluation.evaluate_stored(changed, recording(calls), store, "p").collect()
    evaluation.evaluate_stored(changed, recording(calls), store, "another prompt").collect()
    assert asked(calls).count(1) == 3


def test_calls_in_flight_are_bounded(spark, tmp_path):
    folder = str(tmp_path)

    def judge(text):
        mine = f"{folder}/run-{text.split()[1]}"
        open(mine, "w").close()
        running = len([x for x in os.listdir(folder) if x.startswith("run-")])
        time.sleep(0.05)
        os.remove(mine)
        return '{"score": 1, "comment": "%d"}' % running

    rows = conversations_of(spark, 24)
    out = evaluation.evaluate_stored(rows, judge, str(tmp_path / "store"), in_flight=3, task_rows=1000).collect()
    seen = [int(r.comment) for r in out]
    assert 1 < max(seen) <= 3


# --- CSV -----------------------------------------------------------------------


def result_rows(spark, n):
    return spark.range(n).selectExpr(
        "concat('s', id) AS session_id", "'x, \"y\"' AS scenario", "1 AS score", "'two\nlines' AS comment", "2 AS total_turns", "'completed' AS status", "1.5D AS duration_seconds"
    )


def jobs_of(spark, work):
    group = f"jobs-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_csv_is_one_job_and_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "out" / "r.csv")
    wrote, jobs = jobs_of(spark, lambda: sinks.write_results_csv(result_rows(spark, 50), path))
    assert wrote and jobs == 1
    assert sinks.write_results_csv(result_rows(spark, 20), path)  # appends
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert back.count() == 70 and back.where("scenario = 'x, \"y\"'").count() == 70
    assert os.listdir(tmp_path / "out") == ["r.csv"]
    none = str(tmp_path / "out" / "none.csv")
    wrote, jobs = jobs_of(spark, lambda: sinks.write_summary_csv(result_rows(spark, 0), none))
    assert not wrote and jobs == 1 and not os.path.exists(none)
    assert sorted(x for x in os.listdir(tmp_path / "out") if not x.startswith(".")) == ["r.csv"]


def test_a_failed_write_leaves_the_target_as_it_was(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    assert sinks.write_summary_csv(result_rows(spark, 5), path)
    bad = result_rows(spark, 5).withColumn("score", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_summary_csv(bad, path)
    assert spark.read.option("header", True).csv(path).count() == 5
    assert not [x for x in os.listdir(tmp_path) if x.startswith("_staging")]


# --- documents -----------------------------------------------------------------


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "PART_LINES", 40)
    results = spark.range(300).selectExpr("concat('b ', if(id < 250, '1', '2%')) AS batch_id", "id AS scenario_index", "concat('ä', id) AS session_id")
    path = str(tmp_path / "docs")
    assert sinks.write_document(reports.results_envelope(results), path) == "000000"
    return path, results


def test_a_document_of_several_parts_is_one_json(spark, written):
    path, _ = written
    parts = documents.document_parts(spark, path)
    assert parts.where("batch_id = 'b 1'").count() >= 3
    for batch, n in (("b 1", 250), ("b 2%", 50)):
        whole = json.loads("".join(documents.read_document(spark, path, batch)))
        assert whole["total_results"] == n and [r["scenario_index"] for r in whole["results"]] == sorted(r["scenario_index"] for r in whole["results"])
        assert whole["results"][0]["session_id"] == f"ä{0 if n == 250 else 250}" and len(whole["results"]) == n
    assert documents.damaged_parts(spark, path).count() == 0
    with pytest.raises(documents.DamagedDocument):
        list(documents.read_document(spark, path, "other"))


def test_a_removed_or_changed_part_raises(spark, written):
    path, _ = written
    rows = documents.document_parts(spark, path).where("batch_id = 'b 1'").orderBy("part").collect()
    Folder(spark, path).remove(rows[1].file)
    with open(f"{path}/{rows[2].file}", "a") as f:
        f.write("more")
    folder, _, name = rows[2].file.rpartition("/")
    os.remove(f"{path}/{folder}/.{name}.crc")  # which only local files have
    assert {(r.part, r.problem) for r in documents.damaged_parts(spark, path).collect()} == {(1, "missing"), (2, "changed")}
    with pytest.raises(documents.DamagedDocument, match="part 1"):
        list(documents.read_document(spark, path, "b 1"))
    assert json.loads("".join(documents.read_document(spark, path, "b 2%")))["total_results"] == 50


def test_a_newer_document_replaces_an_older_one(spark, written):
    path, results = written
    fewer = results.where("batch_id = 'b 1' AND scenario_index < 3")
    assert sinks.write_document(reports.results_envelope(fewer), path) == "000001"
    assert json.loads("".join(documents.read_document(spark, path, "b 1")))["total_results"] == 3
    assert json.loads("".join(documents.read_document(spark, path, "b 2%")))["total_results"] == 50
