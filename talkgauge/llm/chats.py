"""Training conversations from reply trees: the best branches of each tree, each formatted as one conversation.

*Trees.*  Messages know their parent.  Iterative self-joins follow the parents, each round twice as far as
the one before: after k rounds a message knows its ancestor 2^k steps up and the sum of scores on the way,
so a path of n messages takes log2(n) rounds, each over two numbers per message and no text.  Leaves then know
length and score of their whole path and are ranked inside their tree.  The same jumps, from the longest to
the shortest, list the messages of the chosen paths only.

*Template.*  A turn is ``### Role:``, a line feed, its text, ``</turn>`` and a line feed.  In texts and roles
a backslash is doubled, and one is put behind each ``#`` that two more follow, behind the ``<`` of ``</turn>``
and behind a ``:`` at the end of a line, so that no text holds a control string.  Dropping each backslash,
keeping what follows it, gives the text back.

A conversation comes in parts of ``PART_TURNS`` turns, which concatenate to the whole, so that one of any
length is never one row.  Each part lists the spans of its loss mask: the escaped texts of the assistant.

Defined results: messages without an id take no part; a parent that is null or not there makes a root;
messages on a cycle, or below one, have no root and take no part; of rows that repeat an id the smallest
(parent, score) and the smallest (role, text) count; a null score is 0; null texts and roles are empty; a null
tree is one of its own; equal branches are ranked by the longer path, then the smaller leaf id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.frames import stored
from talkgauge.llm.ranks import in_order, runs

PART_TURNS = 32
LEARNT = "assistant"
END = "</turn>\n"
HEADS = {"system": "System", "user": "User", "assistant": "Assistant"}  # other roles: "role" and their name


def tree_key(tree: Column) -> Column:
    """A tree's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))


def jumps(links: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors at 1, 2, 4, ... steps, and length and score of the path of each message that has a root.

    ``links`` (tree, id, up, score) has one row per message; ``up`` is null at roots.  Returns tables (tree, id, up), one
    per round, and (tree, id, steps, total).
    """
    known = stored(links.select("tree", "id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), f"{label}-jumps")
    closed, rounds = known.where("up IS NULL"), []
    open_rows = known.where("up IS NOT NULL").count()
    while open_rows:
        going = known.where("up IS NOT NULL")
        rounds.append(going.select("tree", "id", "up"))
        over = going.unionByName(closed).select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        further = going.join(over, ["tree", "up"]).select("tree", "id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        known = stored(further, f"{label}-jumps")
        closed = closed.unionByName(known.where("up IS NULL"))
        left = known.where("up IS NOT NULL").count()
        if left == open_rows:  # only cycles are left: of all others the nearest to their root end in each round
            break
        open_rows = left
    return rounds, closed.select("tree", "id", "steps", "total")


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The messages of the best branches of each tree: (tree, branch from 1, at from 0, id, path_score).

    ``messages`` holds tree_id, message_id, parent_id and score.  A branch's score is the mean of its messages'.
    """
    rows = messages.where("message_id IS NOT NULL").select(
        tree_key(F.col("tree_id")).alias("tree"), F.col("message_id").alias("id"), F.col("parent_id").alias("parent"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    one = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("row")).select("tree", "id", "row.*")
    there = one.select("tree", F.col("id").alias("parent"), F.col("id").alias("up"))
    links = stored(one.join(there, ["tree", "parent"], "left").select("tree", "id", "up", "score"), "chats-links")
    rounds, paths = jumps(links, "chats")
    parents = links.where("up IS NOT NULL").select("tree", F.col("up").alias("id"))
    leaves = paths.join(parents, ["tree", "id"], "left_anti").withColumn("path_score", F.col("total") / F.col("steps"))
    ranked = leaves.selectExpr("*", "row_number() OVER (PARTITION BY tree ORDER BY path_score DESC, steps DESC, id) AS branch").where(F.col("branch") <= branches)
    listed = stored(ranked.select("tree", "branch", "id", "path_score", (F.col("steps") - 1).alias("at")), "chats-paths")
    for k in range(len(rounds) - 1, -1, -1):
        above = listed.join(rounds[k], ["tree", "id"]).select("tree", "branch", F.col("up").alias("id"), "path_score", (F.col("at") - (1 << k)).alias("at"))
        listed = stored(listed.unionByName(above), "chats-paths")
    return listed


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(#(?=##)|<(?=/turn>)|:(?=\n))", r"$1\\")


def unescaped(text: str) -> str:
    """The text without its escapes: in pieces, a backslash keeps the character behind it."""
    parts = text.split("\\")
    out, k = [parts[0]], 1
    while k < len(parts):
        if parts[k] or k + 1 == len(parts):
            out.append(parts[k])
            k += 1
        else:  # two in a row stand for one, and what follows the second is text
            out.append("\\" + parts[k + 1])
            k += 2
    return "".join(out)


def head_of(role: Column) -> Column:
    name = F.concat(F.lit("role "), escaped(role))
    for known, shown in HEADS.items():
        name = F.when(role == known, shown).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(":\n"))


def format_paths(messages: DataFrame, paths: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per part of a conversation: tree, branch, part, parts, path_score, n_turns, formatted and loss_spans.

    ``messages`` holds tree_id, message_id, role and text.  ``loss_spans`` are (start, chars) in code points of
    ``formatted``: the escaped texts of the assistant, in order.
    """
    texts = messages.where("message_id IS NOT NULL").select(tree_key(F.col("tree_id")).alias("tree"), F.col("message_id").alias("id"), "role", "text")
    one = texts.groupBy("tree", "id").agg(F.min(F.struct("role", "text")).alias("said")).select("tree", "id", "said.*")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct("at", head_of(role).alias("head"), escaped(F.col("text")).alias("body"), (role == LEARNT).alias("learnt"))
    turns = paths.join(one, ["tree", "id"]).select("tree", "branch", "path_score", "at", turn.alias("turn"))
    part = F.expr(f"at div {part_turns}").alias("part")
    grouped = turns.groupBy("tree", "branch", part).agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max("path_score").alias("path_score"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END)))
    starts = F.transform("turns", lambda t, i: F.aggregate(F.slice(F.col("_sizes"), F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(t["head"]))
    marked = F.zip_with("turns", "_starts", lambda t, s: F.struct(s.alias("start"), F.length(t["body"]).alias("chars"), t["learnt"].alias("learnt")))
    spans = F.transform(F.filter(marked, lambda m: m["learnt"]), lambda m: F.struct(m["start"].alias("start"), m["chars"].alias("chars")))
    made = grouped.withColumn("_sizes", sizes).withColumn("_starts", starts).select(
        "tree", "branch", "part", "path_score", F.size("turns").alias("n_turns"), F.array_join(written, "").alias("formatted"), spans.alias("loss_spans")
    )
    last = paths.groupBy("tree", "branch").agg((F.expr(f"max(at) div {part_turns}") + 1).alias("parts"))
    return made.join(last, ["tree", "branch"])


def read_part(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a part."""
    names = {shown: role for role, shown in HEADS.items()}
    for turn in formatted.split(END)[:-1]:
        head, body = turn.split(":\n", 1)
        name = head[len("### ") :]
        yield names[name] if name in names else unescaped(name[len("role ") :]), unescaped(body)


DIGEST = "tree string, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose parts follow one another; of each only the running digests are held."""
    own, state = None, None

    def ended() -> tuple:
        return (*own, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        out = []
        for tree, branch, formatted, spans in zip(batch["tree"], batch["branch"], batch["formatted"], batch["loss_spans"]):
            if own != (tree, branch):
                if own:
                    out.append(ended())
                own, state = (tree, branch), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_part(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescaped(formatted[span["start"] : span["start"] + span["chars"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")])
    if own:
        yield pd.DataFrame([ended()], columns=[c.split()[0] for c in DIGEST.split(", ")])


def conversation_digests(parts: DataFrame) -> DataFrame:
    """What the formatted parts hold, read back from them: one row per conversation.

    A conversation of one part is read where it lies.  The others are brought together in order and streamed
    through running digests: SHA-256 takes a text from its begin to its end, so one conversation is one task's
    work, in the memory of a batch.
    """
    columns = ["tree", "branch", "part", "formatted", "loss_spans"]
    short = parts.where("parts = 1").select(columns)
    long = parts.where("parts > 1").select(columns).repartition("tree", "branch").sortWithinPartitions("tree", "branch", "part")
    return short.mapInPandas(_digests, DIGEST).unionByName(long.mapInPandas(_digests, DIGEST))


def linear_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each row answers the one before.

    Returns the links (tree_id, message_id, parent_id, score) and the texts (tree_id, message_id, role, text).

    Rows follow one another by turn, rows of one turn by role and text, nulls first.  Only numbers are looked at
    to find a row's predecessor: rows of a run answer each other, and a run's first row the last of the run before.
    """
    ordered = in_order(conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], "chats-rows")
    found = runs(ordered, ["conv_id"], "chats-runs")
    rows = found.select("conv_id", "first", "previous", F.explode(F.sequence("first", "last")).alias("message_id"))
    links = rows.select(
        F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > F.col("first"), F.col("message_id") - 1).otherwise(F.col("previous")).alias("parent_id"), F.lit(0.0).alias("score")
    )
    return links, ordered.select(F.col("conv_id").alias("tree_id"), F.col("at").alias("message_id"), "role", "text")


def format_trees(messages: DataFrame, branches: int = 1, part_turns: int = PART_TURNS) -> DataFrame:
    """The best branches of reply trees (tree_id, message_id, parent_id, score, role, text), formatted and stored."""
    return stored(format_paths(messages, chosen_paths(messages, branches), part_turns), "chats")
