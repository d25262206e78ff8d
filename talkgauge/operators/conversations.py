"""Conversation operators over message rows.

Input rows: `session_id, msg_index, speaker, content, ts` with dense `msg_index` from 0
and non-decreasing `ts`.  `speaker` is `agent`, `client`, or anything else (such as
`system`) for messages that are not part of the exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import text
from talkgauge.operators import blocks

# Rows of one conversation that are put into a single array or text.
PART_ROWS = 1000


def number_turns(
    messages: DataFrame,
    first_speaker: str = "agent",
    block_rows: int = blocks.BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add `turn_number`: the exchange a message belongs to, from 1.

    An exchange starts with each message of the speaker who opens the conversation.
    """
    opens = F.when(F.col("speaker") == first_speaker, 1).otherwise(0)
    return blocks.running_total(
        messages,
        ["session_id"],
        "msg_index",
        opens,
        "turn_number",
        block_rows=block_rows,
        keep_block=keep_block,
    )


def ends_conversation(
    agent_markers: Iterable[str] = c.AGENT_END_MARKERS,
    client_markers: Iterable[str] = c.CLIENT_END_MARKERS,
) -> Column:
    """True for a message whose text ends the call; markers differ by speaker."""
    content = F.col("content")
    return (
        F.when(F.col("speaker") == "agent", text.contains_any(content, agent_markers))
        .when(F.col("speaker") == "client", text.contains_any(content, client_markers))
        .otherwise(F.lit(False))
    )


def end_detection(messages: DataFrame, **markers: Iterable[str]) -> DataFrame:
    return messages.withColumn("ends", F.coalesce(ends_conversation(**markers), F.lit(False)))


def _clocked(flags: DataFrame, first_speaker: str, block_rows: int) -> DataFrame:
    """Add `turn_number` and `_elapsed`, seconds from the first to the previous message.

    Both are taken in one pass over the blocks of each session; the state carried into
    later blocks is joined in only for sessions that have them.
    """
    opens = F.when(F.col("speaker") == first_speaker, 1).otherwise(0)
    blocked = blocks.with_block(flags.withColumn("_opens", opens), "msg_index", block_rows)
    by_block = Window.partitionBy("session_id").orderBy(blocks.BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("session_id", blocks.BLOCK)
        .agg(
            F.sum("_opens").alias("_block_turns"),
            F.min_by("ts", "msg_index").alias("_first_ts"),
            F.max_by("ts", "msg_index").alias("_last_ts"),
        )
        .select(
            "session_id",
            blocks.BLOCK,
            F.sum("_block_turns").over(earlier).alias("_carried_turns"),
            F.first("_first_ts").over(earlier).alias("_carried_start"),
            F.lag("_last_ts").over(by_block).alias("_carried_ts"),
        )
        .filter(F.col("_carried_turns").isNotNull())
    )
    inside = Window.partitionBy("session_id", blocks.BLOCK).orderBy("msg_index")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce("_carried_start", "_inside_start")
    previous = F.coalesce("_inside_ts", "_carried_ts")
    return (
        blocked.withColumns(
            {
                "_inside_turns": F.sum("_opens").over(so_far),
                "_inside_start": F.first("ts").over(so_far),
                "_inside_ts": F.lag("ts").over(inside),
            }
        )
        .join(carried, ["session_id", blocks.BLOCK], "left")
        .withColumn(
            "turn_number", F.col("_inside_turns") + F.coalesce("_carried_turns", F.lit(0))
        )
        .withColumn("_elapsed", text.seconds_between(start, previous))
    )


def cut_points(
    messages: DataFrame,
    first_speaker: str = "agent",
    max_turns: int | None = None,
    timeout_seconds: float | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    **markers: Iterable[str],
) -> DataFrame:
    """Where each conversation stops: one row per session.

    `agent_end_index` and `client_end_index` are the first messages of each side that end
    the call (kept), `max_turns_index` the agent message of the last allowed exchange
    (kept), `timeout_index` the first message of the first exchange that would start too
    late (not kept); NULL where a rule never applies.  Only flags travel through the
    shuffles, never the message text; rules whose column is not used are not computed.
    """
    max_turns = max_turns or c.MAX_TURNS
    timeout_seconds = timeout_seconds or c.TIMEOUT_SECONDS
    flags = end_detection(messages, **markers).select(
        "session_id", "msg_index", "speaker", "ts", "ends"
    )
    agent, client = F.col("speaker") == "agent", F.col("speaker") == "client"
    late = (F.col("speaker") == first_speaker) & (F.col("_elapsed") > timeout_seconds)

    def first_where(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("msg_index")))

    return (
        _clocked(flags, first_speaker, block_rows)
        .groupBy("session_id")
        .agg(
            first_where(agent & F.col("ends")).alias("agent_end_index"),
            first_where(client & F.col("ends")).alias("client_end_index"),
            first_where(agent & (F.col("turn_number") >= max_turns)).alias("max_turns_index"),
            first_where(late).alias("timeout_index"),
            F.max("msg_index").alias("last_index"),
        )
    )


def _keep_until(
    messages: DataFrame, last_kept: DataFrame, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Keep each session's messages up to its `_last_kept` index, block by block."""
    limits = blocks.spread_over_blocks(
        last_kept.filter(F.col("_last_kept") >= 0), F.col("_last_kept"), block_rows
    )
    return (
        blocks.with_block(messages, "msg_index", block_rows)
        .join(limits, ["session_id", blocks.BLOCK])
        .filter(F.col("msg_index") <= F.col("_last_kept"))
        .drop("_last_kept", blocks.BLOCK)
    )


def cut_at_end(
    messages: DataFrame,
    first_speaker: str = "agent",
    max_turns: int | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    **markers: Iterable[str],
) -> DataFrame:
    """Keep messages up to and including the one that ends the conversation."""
    cuts = cut_points(messages, first_speaker, max_turns, None, block_rows, **markers)
    last_kept = F.least("agent_end_index", "client_end_index", "max_turns_index", "last_index")
    return _keep_until(
        messages, cuts.select("session_id", last_kept.alias("_last_kept")), block_rows
    )


def cut_at_timeout(
    messages: DataFrame,
    first_speaker: str = "agent",
    timeout_seconds: float | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Drop the exchanges that would start after the time limit.

    The clock is read only before an exchange starts and has to be strictly past the
    limit, so an exchange that has begun is always kept whole.
    """
    cuts = cut_points(messages, first_speaker, None, timeout_seconds, block_rows)
    last_kept = F.coalesce(F.col("timeout_index") - 1, F.col("last_index"))
    return _keep_until(
        messages, cuts.select("session_id", last_kept.alias("_last_kept")), block_rows
    )


def end_reason(cuts: DataFrame) -> DataFrame:
    """Why each conversation stopped, from `cut_points`; the earliest rule decides."""
    stop = F.least("agent_end_index", "client_end_index", "max_turns_index")
    timed_out = F.col("timeout_index").isNotNull() & (
        stop.isNull() | (F.col("timeout_index") <= stop)
    )
    reason = (
        F.when(timed_out, "timeout")
        .when(F.col("agent_end_index") == stop, "agent_end")
        .when(F.col("client_end_index") == stop, "client_end")
        .when(stop.isNotNull(), "max_turns")
        .otherwise("failed")
    )
    last_kept = F.coalesce(
        F.when(timed_out, F.col("timeout_index") - 1), stop, F.col("last_index")
    )
    return cuts.select("session_id", reason.alias("end_reason"), last_kept.alias("last_msg_index"))


def total_turns(messages: DataFrame) -> DataFrame:
    """Exchanges started (agent messages) and, separately, all exchanged messages."""
    return messages.groupBy("session_id").agg(
        F.count_if(F.col("speaker") == "agent").alias("total_turns"),
        F.count_if(F.col("speaker") != "system").alias("n_messages"),
    )


def conversation_history(
    messages: DataFrame, first_speaker: str = "agent", part_rows: int = PART_ROWS
) -> DataFrame:
    """The ordered, numbered history of each conversation as arrays.

    One row per session and part; a part holds `part_rows` consecutive messages, so every
    conversation of usual length is part 0 and no array grows without bound.  Turns are
    numbered in the same parts, so message texts are shuffled once.
    """
    numbered = number_turns(messages, first_speaker, part_rows, keep_block=True)
    entry = F.struct(
        "msg_index",
        F.col("turn_number").alias("turn"),
        "speaker",
        "content",
        F.col("ts").alias("timestamp"),
    )
    return numbered.groupBy("session_id", F.col(blocks.BLOCK).alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("history")
    )


def transcript_text(
    messages: DataFrame,
    sessions: DataFrame | None = None,
    first_speaker: str = "agent",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The text an evaluator reads, one row per session and part.

    Concatenating the parts of a session in order gives its whole transcript.  Sessions
    listed in `sessions` without any message get a transcript of header and footer only.
    """
    spoken = messages.withColumn(
        "content", F.when(F.col("speaker") != "system", F.coalesce("content", F.lit("")))
    )
    history = conversation_history(spoken, first_speaker, part_rows)
    last_part = F.floor(F.max("msg_index") / F.lit(part_rows)).cast("bigint")
    last_parts = messages.groupBy("session_id").agg(last_part.alias("part"))

    def line(entry: Column) -> Column:
        label = F.when(entry["speaker"] == "agent", c.AGENT_LABEL).otherwise(c.CLIENT_LABEL)
        return F.concat(
            F.lit(f"{c.TURN_WORD} "),
            entry["turn"].cast("string"),
            F.lit(" - "),
            label,
            F.lit(": "),
            entry["content"],
            F.lit("\n\n"),
        )

    # a system message has no line, and array_join leaves NULLs out
    body = F.array_join(F.transform("history", line), "")
    header = F.when(F.col("part") == 0, c.TRANSCRIPT_HEADER).otherwise("")
    footer = F.when(F.col("_is_last"), c.TRANSCRIPT_FOOTER).otherwise("")
    transcripts = history.join(
        last_parts.withColumn("_is_last", F.lit(True)), ["session_id", "part"], "left"
    ).select("session_id", "part", F.concat(header, body, footer).alias("transcript"))
    if sessions is None:
        return transcripts
    silent = sessions.select("session_id").distinct().join(last_parts, "session_id", "left_anti")
    return transcripts.unionByName(
        silent.select(
            "session_id",
            F.lit(0).cast("bigint").alias("part"),
            F.lit(c.TRANSCRIPT_HEADER + c.TRANSCRIPT_FOOTER).alias("transcript"),
        )
    )


def _model_context(
    messages: DataFrame, system_prompts: DataFrame, roles: dict[str, str], kickoff: str | None
) -> DataFrame:
    """Context entries as rows; see `agent_context`."""
    opening = [F.struct(F.lit(-2).alias("i"), F.lit("system").alias("r"), F.col("prompt").alias("t"))]
    if kickoff is not None:
        opening.append(
            F.struct(F.lit(-1).alias("i"), F.lit("user").alias("r"), F.lit(kickoff).alias("t"))
        )
    head = system_prompts.select("session_id", F.inline(F.array(*opening))).select(
        "session_id",
        F.col("i").cast("bigint").alias("msg_index"),
        F.col("r").alias("role"),
        F.col("t").alias("content"),
    )
    role = F.when(F.col("speaker") == "agent", roles["agent"]).otherwise(roles["client"])
    body = messages.filter(F.col("speaker") != "system").select(
        "session_id", "msg_index", role.alias("role"), "content"
    )
    return head.unionByName(body)


def agent_context(messages: DataFrame, system_prompts: DataFrame) -> DataFrame:
    """What the agent model sees, as one ordered list of entries per session.

    The context of the agent's message at index *m* is exactly the entries with
    `msg_index < m`, in order; opening entries have negative indexes.  Contexts of
    different turns are prefixes of one list, so the list is stored once instead of
    once per turn.  `context_at` builds the arrays for requested messages.
    """
    roles = {"agent": "assistant", "client": "user"}
    return _model_context(messages, system_prompts, roles, c.KICKOFF_MESSAGE)


def client_context(messages: DataFrame, system_prompts: DataFrame) -> DataFrame:
    """What the client model sees: agent text as `assistant`, its own as `user`."""
    roles = {"agent": "assistant", "client": "user"}
    return _model_context(messages, system_prompts, roles, None)


def context_at(
    context: DataFrame, requests: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Chat arrays for requested messages: `requests(session_id, msg_index)`, one per session.

    One row per request and part of `part_rows` entries; the parts in order are the whole
    context, and a conversation of usual length has one.
    """
    wanted = requests.select("session_id", F.col("msg_index").alias("_at"))
    entry = F.struct("msg_index", "role", "content")
    # the two opening entries have the indexes -2 and -1
    part = F.floor((F.col("msg_index") + 2) / F.lit(part_rows)).cast("bigint")
    return (
        context.join(wanted, "session_id")
        .filter(F.col("msg_index") < F.col("_at"))
        .groupBy("session_id", F.col("_at").alias("msg_index"), part.alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(
            "session_id",
            "msg_index",
            "part",
            F.transform(
                "_entries", lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content"))
            ).alias("messages"),
        )
    )


def conversation_result(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One result row per session: turns, start, end and duration.

    `sessions(session_id, scenario, status, error, ...)` lists every conversation; extra
    columns are kept.  Messages are pre-aggregated before the join.
    """
    spans = messages.groupBy("session_id").agg(
        F.count_if(F.col("speaker") == "agent").cast("int").alias("total_turns"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )
    joined = sessions.join(spans, "session_id", "left")
    return (
        joined.withColumn("scenario", F.coalesce("scenario", F.lit("unknown")))
        .withColumn("total_turns", F.coalesce("total_turns", F.lit(0)))
        .withColumn(
            "duration_seconds", text.seconds_between(F.col("start_time"), F.col("end_time"))
        )
        .withColumn("error", F.when(F.col("status") == "failed", F.col("error")))
    )
