"""Conversation rules against a direct, message-by-message replay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.operators import conversations as ops

SCHEMA = "session_id string, msg_index bigint, speaker string, content string, ts timestamp_ntz"
BASE = datetime(2025, 6, 8, 10, 0, 0)


def conversation(session, texts, step=10):
    return [
        (session, i, "agent" if i % 2 == 0 else "client", text, BASE + timedelta(seconds=step * i))
        for i, text in enumerate(texts)
    ]


def frame(spark, *conversations):
    return spark.createDataFrame([m for conv in conversations for m in conv], SCHEMA)


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.session_id, []).append(r.msg_index)
    return {k: sorted(v) for k, v in out.items()}


def reasons(df):
    return {r.session_id: r.end_reason for r in df.collect()}


def test_end_markers_by_speaker(spark):
    df = frame(
        spark,
        conversation("agent_ends", ["hi", "yes", "Bye END_CALL now", "later"]),
        conversation("client_ends", ["hi", "Ну наконец то", "more"]),
        conversation("agent_says_thanks", ["спасибо", "end_call", "ok", "СПАСИБО!", "x"]),
        conversation("open", ["a", "b"]),
    )
    assert kept(ops.cut_at_end(df)) == {
        "agent_ends": [0, 1, 2], "client_ends": [0, 1], "agent_says_thanks": [0, 1, 2, 3], "open": [0, 1],
    }
    assert reasons(ops.end_reason(ops.cut_points(df))) == {
        "agent_ends": "agent_end", "client_ends": "client_end",
        "agent_says_thanks": "client_end", "open": "failed",
    }


def test_max_turns_keeps_the_last_agent_message(spark):
    df = frame(spark, conversation("long", ["m"] * 9, step=1))
    assert kept(ops.cut_at_end(df, max_turns=3)) == {"long": [0, 1, 2, 3, 4]}
    assert kept(ops.cut_at_end(df, max_turns=0)) == {"long": list(range(9))}
    assert reasons(ops.end_reason(ops.cut_points(df, max_turns=3))) == {"long": "max_turns"}


def test_timeout_is_strict_and_only_between_turns(spark):
    df = frame(spark, conversation("slow", ["m"] * 8, step=30), conversation("edge", ["m"] * 5, step=90))
    # slow: the message before turn 3 is at 90 s, which is not past the limit; before turn 4 at 150 s
    # edge: before turn 2 the clock is exactly 90 s, before turn 3 it is 270 s
    assert kept(ops.cut_at_timeout(df)) == {"slow": [0, 1, 2, 3, 4, 5], "edge": [0, 1, 2, 3]}
    assert reasons(ops.end_reason(ops.cut_points(df))) == {"slow": "timeout", "edge": "timeout"}


def replay(messages, max_turns, timeout):
    """Walk one conversation as it would have run; (kept indexes, reason)."""
    out, turn, start, last = [], 0, messages[0][4], messages[0][4]
    for _, i, speaker, content, ts in messages:
        if speaker == "agent":
            if (last - start).total_seconds() > timeout:
                return out, "timeout"
            turn += 1
        out.append(i)
        last = ts
        if speaker == "agent" and "end_call" in content.lower():
            return out, "agent_end"
        if speaker == "agent" and turn >= max_turns:
            return out, "max_turns"
        if speaker == "client" and any(m in content.lower() for m in c.CLIENT_END_MARKERS):
            return out, "client_end"
    return out, "failed"


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_random_conversations_equal_replay(spark, block_rows):
    rnd = random.Random(3)
    words = ["a", "b", "c", "d", "e", "f", "ok", "конец", "end_call"]
    convs = []
    for k in range(60):
        size = 300 if k == 0 else rnd.randint(1, 14)
        pool = words[:6] if k == 0 else words
        step = 0 if k == 0 else rnd.choice([1, 12, 40])
        convs.append(conversation(f"s{k}", [rnd.choice(pool) for _ in range(size)], step))
    df = frame(spark, *convs).repartition(7)
    limit = 1000
    cuts = ops.cut_points(df, max_turns=limit, block_rows=block_rows)
    got = {r.session_id: (r.end_reason, r.last_msg_index) for r in ops.end_reason(cuts).collect()}
    want = {}
    for conv in convs:
        indexes, reason = replay(conv, limit, 90)
        want[conv[0][0]] = (reason, indexes[-1])
    assert got == want
    at_end = kept(ops.cut_at_end(df, max_turns=5, block_rows=block_rows))
    assert at_end == {conv[0][0]: replay(conv, 5, 10**9)[0] for conv in convs}
    again = ops.cut_at_end(
        ops.cut_at_end(df, max_turns=5, block_rows=block_rows), max_turns=5, block_rows=block_rows
    )
    assert kept(again) == at_end
    by_time = kept(ops.cut_at_timeout(df, block_rows=block_rows))
    no_words = [[(s, i, w, "", t) for s, i, w, _, t in conv] for conv in convs]
    assert by_time == {conv[0][0]: replay(conv, 10**9, 90)[0] for conv in no_words}


def test_transcript(spark):
    df = frame(spark, conversation("s", ["Привет", "Да", "Пока"]))
    sessions = spark.createDataFrame([("s",), ("empty",)], "session_id string")
    out = {r.session_id: r.transcript for r in ops.transcript_text(df, sessions).collect()}
    head, foot = "=== РАЗГОВОР ДЛЯ ОЦЕНКИ ===\n\n", "=== КОНЕЦ РАЗГОВОРА ==="
    assert out == {
        "s": head + "Ход 1 - АГЕНТ: Привет\n\nХод 1 - КЛИЕНТ: Да\n\nХод 2 - АГЕНТ: Пока\n\n" + foot,
        "empty": head + foot,
    }


def test_long_transcripts_come_in_parts_that_lose_nothing(spark):
    df = frame(spark, conversation("s", [f"m{i}" for i in range(25)]))
    whole = ops.transcript_text(df).first().transcript
    parts = sorted((r.part, r.transcript) for r in ops.transcript_text(df, part_rows=4).collect())
    assert len(parts) == 7 and "".join(t for _, t in parts) == whole
    history = ops.conversation_history(df, part_rows=4)
    assert history.agg(F.max(F.size("history"))).first()[0] == 4


def test_contexts_follow_the_roles(spark):
    df = frame(spark, conversation("s", ["hello", "order", "sure", "thanks"]))
    prompts = spark.createDataFrame([("s", "SYS")], "session_id string, prompt string")
    def listed(ctx):
        return [(r.role, r.content) for r in sorted(ctx.collect(), key=lambda r: r.msg_index)]

    assert listed(ops.agent_context(df, prompts)) == [
        ("system", "SYS"), ("user", c.KICKOFF_MESSAGE), ("assistant", "hello"), ("user", "order"),
        ("assistant", "sure"), ("user", "thanks"),
    ]
    assert listed(ops.client_context(df, prompts)) == [
        ("system", "SYS"), ("assistant", "hello"), ("user", "order"), ("assistant", "sure"), ("user", "thanks"),
    ]
    at = spark.createDataFrame([("s", 2)], "session_id string, msg_index bigint")
    row = ops.context_at(ops.agent_context(df, prompts), at).first()
    assert [(m.role, m.content) for m in row.messages] == [
        ("system", "SYS"), ("user", c.KICKOFF_MESSAGE), ("assistant", "hello"), ("user", "order"),
    ]


def test_conversation_result(spark):
    df = frame(spark, conversation("s", ["a", "b", "c"], step=15))
    sessions = spark.createDataFrame(
        [("s", "sc", "completed", "x"), ("none", None, "failed", "lost")],
        "session_id string, scenario string, status string, error string",
    )
    out = {r.session_id: r for r in ops.conversation_result(df, sessions).collect()}
    assert (out["s"].total_turns, out["s"].duration_seconds, out["s"].error) == (2, 30.0, None)
    assert (out["none"].scenario, out["none"].total_turns, out["none"].error) == ("unknown", 0, "lost")


def test_total_turns_counts_exchanges_and_messages(spark):
    row = ops.total_turns(frame(spark, conversation("s", ["a", "b", "c"]))).first()
    assert (row.total_turns, row.n_messages) == (2, 3)
