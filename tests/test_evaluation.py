"""Golden evaluator replies."""

import pytest
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.operators import evaluation

INV = c.COMMENT_INVALID_REPLY
BLANK = c.COMMENT_BLANK
ABSENT = c.COMMENT_ABSENT


def bad(text=""):
    return c.COMMENT_BAD_SCORE_PREFIX + text


REPLIES = [
    ('{"score":3,"comment":"ok"}', 3, "ok", "success"),
    ('{"score":2.0,"comment":"x"}', 1, bad("x"), "success"),
    ('{"score":1e0}', 1, bad(), "success"),
    ('{"score":"3"}', 1, bad(), "success"),
    ('{"score":true,"comment":"b"}', 1, "b", "success"),
    ('{"score":false,"comment":"b"}', 1, bad("b"), "success"),
    ('{"score":null,"comment":null}', 1, bad("None"), "success"),
    ('{"score":9,"comment":true}', 1, bad("True"), "success"),
    ('{"score":5,"comment":""}', 1, bad(), "success"),
    ('{"score":0,"comment":"z"}', 1, bad("z"), "success"),
    ('{"comment":"z"}', 1, bad("z"), "success"),
    ("{}", 1, bad(), "success"),
    ('{"score":3,"comment":0}', 3, ABSENT, "success"),
    ('{"score":3,"comment":0.0}', 3, ABSENT, "success"),
    ('{"score":3,"comment":null}', 3, ABSENT, "success"),
    ('{"score":3,"comment":[]}', 3, ABSENT, "success"),
    ('{"score":3,"comment":{}}', 3, ABSENT, "success"),
    ('{"score":3,"comment":false}', 3, ABSENT, "success"),
    ('{"score":3,"comment":true}', 3, "True", "success"),
    ('{"score":2,"comment":7}', 2, "7", "success"),
    ('{"score":3,"comment":{"a":1}}', 3, '{"a":1}', "success"),
    ('{"score":3,"comment":"  "}', 3, BLANK, "success"),
    ('{"score":3,"comment":"\\u00a0\\n\\t"}', 3, BLANK, "success"),
    ('{"score":3}', 3, BLANK, "success"),
    ('{"error":"e","score":3}', 1, INV, "success"),
    ('{"error":null,"score":3}', 1, INV, "success"),
    ("{'score':3}", 1, INV, "success"),
    ('{"score":1,}', 1, INV, "success"),
    ("not json", 1, INV, "success"),
    ("", 1, INV, "success"),
    ('{"score":3,"comment":"a"} trailing', 1, INV, "success"),
    ('{"score":3}] trailing', 1, INV, "success"),
    ('{"score":3}] trailing }', 1, INV, "success"),
    ('{"score":3},{"score":2}', 1, INV, "success"),
    ('{"score":1,"score":2}', 2, BLANK, "success"),
    (' {"score":2,"comment":"пробел"} ', 2, "пробел", "success"),
    ('{"score":NaN}', 1, INV, "success"),
]
FAILED = ["[1,2]", "7", "1.5", "null", "true", '"an error"', '["error"]', None]


@pytest.fixture(scope="module")
def judged(spark):
    raws = [r[0] for r in REPLIES] + FAILED
    df = spark.createDataFrame([(str(i), raw) for i, raw in enumerate(raws)], "session_id string, raw string")
    return {r.session_id: r for r in evaluation.evaluate_replies(df).collect()}


@pytest.mark.parametrize("i", range(len(REPLIES)), ids=[r[0] for r in REPLIES])
def test_golden_reply(judged, i):
    raw, score, comment, status = REPLIES[i]
    row = judged[str(i)]
    assert (row.score, row.comment, row.evaluation_status) == (score, comment, status)


@pytest.mark.parametrize("k", range(len(FAILED)), ids=[str(f) for f in FAILED])
def test_unreadable_reply_fails(judged, k):
    row = judged[str(len(REPLIES) + k)]
    assert row.score == 1 and row.evaluation_status == "failed"
    assert row.comment == c.COMMENT_EVALUATION_FAILED_PREFIX + row.error


def test_judge_failure_stays_with_its_conversation(spark):
    def judge(transcript):
        if "boom" in transcript:
            raise RuntimeError("down")
        return '{"score":2,"comment":"%s"}' % transcript

    rows = spark.createDataFrame(
        [(0, "a", "s", "one"), (1, "b", None, "boom"), (2, None, "s", "three")],
        "conversation_index bigint, session_id string, scenario string, transcript string",
    )
    out = {r.conversation_index: r for r in evaluation.evaluate_batch(rows, judge).collect()}
    assert (out[0].score, out[0].comment, out[0].evaluation_status) == (2, "one", "success")
    assert (out[1].score, out[1].evaluation_status, out[1].scenario) == (1, "failed", "unknown")
    assert out[1].comment == c.COMMENT_EVALUATION_FAILED_PREFIX + "down"
    assert out[2].session_id == "unknown_2"


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "score int, evaluation_status string")
    row = evaluation.evaluation_summary(empty).first()
    assert row.asDict() == {
        "total_evaluations": 0, "successful_evaluations": 0, "average_score": 0.0,
        "score_1": 0, "score_2": 0, "score_3": 0, "success_rate": 0.0,
    }


def test_summary_counts_missing_scores_as_one(spark):
    df = spark.createDataFrame([(None, "failed"), (3, "success"), (2, "success")], "score int, evaluation_status string")
    row = evaluation.evaluation_summary(df).first()
    assert (row.average_score, row.score_1, row.successful_evaluations) == (2.0, 1, 2)


def test_requests_have_two_messages(spark):
    t = spark.createDataFrame([("s", 0, "text")], "session_id string, part bigint, transcript string")
    row = evaluation.evaluator_request(t, "prompt").first()
    assert [(m.role, m.content) for m in row.messages] == [("system", "prompt"), ("user", "text")]


def test_conversations_without_reply_keep_nulls(spark):
    conv = spark.createDataFrame([("a",), ("b",)], "session_id string")
    ev = conv.filter("session_id = 'a'").select(
        "session_id", F.lit(3).alias("score"), F.lit("x").alias("comment"), F.lit("success").alias("evaluation_status")
    )
    out = {r.session_id: r.score for r in evaluation.join_evaluation(conv, ev).collect()}
    assert out == {"a": 3, "b": None}
