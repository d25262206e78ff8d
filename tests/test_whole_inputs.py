"""Inputs of any size and shape: evaluator requests, readers, medians, scratch folders, hot pieces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.operators import catalog, conversations, evaluation, results as rows
from talkgauge.operators.medians import grouped_medians
from talkgauge.session import scratch_path
from talkgauge.sources import logs, results as files, sinks
from talkgauge.streaming import jobs


def messages(spark, n: int, speakers: list[str]):
    data = [("s", k, speakers[k % len(speakers)], f"m{k}") for k in range(n)]
    frame = spark.createDataFrame(data, "session_id string, msg_index bigint, speaker string, content string")
    return frame.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@pytest.mark.parametrize("n,speakers", [(1500, ["agent", "client"]), (1500, ["agent", "client", "client"]), (3, ["client"])])
def test_one_request_and_one_judgement_per_conversation(spark, n, speakers):
    parts = conversations.transcript_text(messages(spark, n, speakers), part_rows=100)
    joined = "".join(r.transcript for r in parts.orderBy("part").collect())
    assert joined.startswith(c.TRANSCRIPT_HEADER) and joined.endswith(c.TRANSCRIPT_FOOTER) and f"m{n - 1}" in joined
    requests = evaluation.evaluator_request(parts, "Grade.").collect()
    assert len(requests) == 1 and [m.content for m in requests[0].messages] == ["Grade.", joined]
    asked = evaluation.whole_transcripts(parts).withColumns({"conversation_index": F.lit(7), "scenario": F.lit("x")})
    judged = evaluation.evaluate_batch(asked, lambda t: '{"score":2,"comment":"%d"}' % len(t)).collect()
    assert [(r.conversation_index, r.score, r.comment) for r in judged] == [(7, 2, str(len(joined)))]


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "results.csv"
    path.write_text("score,session_id,turns,other\n2.0,a,3,x\n,b,,y\n")
    got = files.load_results(spark, str(path)).orderBy("session_id").collect()
    assert [(r.session_id, r.score, r.total_turns, r.duration_seconds, r.start_time) for r in got] == [("a", 2, 3, None, None), ("b", None, None, None, None)]


@pytest.mark.parametrize("cell", ["notnum", "2.5"])
def test_a_bad_cell_fails_the_load(spark, tmp_path, cell):
    path = tmp_path / "results.csv"
    path.write_text(f"session_id,score\na,{cell}\n")
    with pytest.raises(Exception, match="score is not INT"):
        files.load_results(spark, str(path)).collect()


def test_summary_csv_can_be_loaded(spark, tmp_path):
    results = spark.createDataFrame([("a", 3, "completed")], "session_id string, score int, status string")
    path = str(tmp_path / "summary.csv")
    assert sinks.write_summary_csv(results, path) and not sinks.write_summary_csv(results.filter("false"), path)
    assert [(r.session_id, r.score, r.status) for r in files.load_results(spark, path).collect()] == [("a", 3, "completed")]


def test_broken_log_lines_are_no_turns(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"session_id":"s","turn_number":1,"role":"agent","content":"hi"}\n{"session_id":\n7\n')
    turns, completions = logs.read_conversation_log(spark, str(path))
    assert [r.session_id for r in turns.collect()] == ["s"] and completions.count() == 0


def test_csv_rows_without_a_start(spark):
    results = spark.createDataFrame([("a", 3)], "session_id string, score int")
    assert rows.csv_rows(results).first().start_ts == ""


def test_scratch_must_be_shared_on_a_cluster(spark):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
    Session.conf["spark.checkpoint.dir"] = "/shared"
    assert scratch_path(Session, "x").startswith("/shared/x-")


def test_upserts_on_nothing_and_over_several_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    schema = "batch_id string, status string"
    spark.createDataFrame([], schema).write.json(source)

    def run():
        stream = jobs.stream_batch_progress(spark.readStream.schema(schema).json(source))
        return {r.batch_id: r.total_scenarios for r in jobs.run_upserts(spark, stream, ["batch_id"], out, check).collect()}

    assert run() == {}
    for k, want in enumerate(({"a": 1}, {"a": 2, "b": 1}, {"a": 2, "b": 2})):
        data = [("a", "completed")] if k == 0 else [("a", "failed"), ("b", "completed")] if k == 1 else [("b", "failed")]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(source)
        assert run() == want


def test_medians_of_many_distinct_values(spark):
    n = 300_001
    frame = spark.range(n).select(F.lit("g").alias("k"), (F.col("id") * 1.5).alias("d"), (F.col("id") % 3).cast("int").alias("i"))
    frame = frame.unionByName(spark.createDataFrame([("h", 1.0, 5), ("h", 4.0, None), ("n", None, None)], "k string, d double, i int"))
    got = {r.k: (r.d_median, r.i_median) for r in grouped_medians(frame, ["k"], ["d", "i"]).collect()}
    assert got == {"g": ((n - 1) / 2 * 1.5, 1.0), "h": (2.5, 5.0)}


def test_a_piece_of_every_name_is_split_and_not_broadcast(spark):
    items = spark.range(4000).select(
        F.col("id").alias("item_id"), F.concat(F.lit("all "), "id").alias("name"), F.lit("Cat").alias("category"), F.lit(1.0).alias("price")
    )
    searches = spark.createDataFrame([(1, "ALL", ""), (2, "", "ca"), (3, "", "dog"), (4, "9", "cat"), (5, "", "")], "search_id int, query string, category string")
    found = catalog.catalog_search(items, searches)
    counts = {r.search_id: r["count"] for r in found.groupBy("search_id").count().collect()}
    assert counts == {1: 4000, 2: 4000, 4: sum("9" in str(k) for k in range(4000)), 5: 4000}
    pieces = found.filter("search_id = 1")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_gram" in pieces and "_share" in pieces
