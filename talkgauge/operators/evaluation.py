"""Evaluator replies: parsing, validation, fallbacks and the judge hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import numbers, strict_json, text
from talkgauge.sources.commits import Folder


def parse_evaluation(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `reply` (VARIANT, NULL when the text is not valid JSON) and its `reply_kind`."""
    return replies.withColumn("reply", strict_json.parse_strict(F.col(raw))).withColumn(
        "reply_kind",
        F.when(F.col("reply").isNotNull(), strict_json.kind(F.col("reply")))
        .when(F.col(raw).isNotNull(), F.lit("INVALID"))
        .otherwise(F.lit("MISSING")),
    )


def _spoken(kind: Column, text_of_value: Column) -> Column:
    """Text of a JSON value inside a sentence."""
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text_of_value))
        .otherwise(text_of_value)
    )


def _is_falsy(kind: Column, text_of_value: Column) -> Column:
    is_zero = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (
        text_of_value.try_cast("double") == 0
    )
    return (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (text_of_value == "false"))
        | is_zero
        | (kind.isin("ARRAY", "OBJECT") & text_of_value.isin("[]", "{}"))
    )


def _invalid(reply_kind: Column, reply: Column) -> Column:
    """Text that is not JSON, or an object that carries an `error` key."""
    return (reply_kind == "INVALID") | (
        (reply_kind == "OBJECT") & strict_json.has_field(reply, "error")
    )


def validate_score(parsed: DataFrame) -> DataFrame:
    """Add `score_valid` and `score` (the fallback score wherever it is not valid).

    Valid is a JSON integer 1, 2 or 3; `true` counts as the integer 1.
    """
    reply, reply_kind = F.col("reply"), F.col("reply_kind")
    typed = parsed.withColumn("_score", strict_json.field(reply, "score")).withColumns(
        {
            "_score_kind": strict_json.kind(F.col("_score")),
            "_score_text": F.col("_score").cast("string"),
        }
    )
    usable = (reply_kind == "OBJECT") & ~_invalid(reply_kind, reply)
    is_integer = (F.col("_score_kind") == "BIGINT") & F.col("_score_text").isin(
        *[str(score) for score in c.VALID_SCORES]
    )
    is_true = (F.col("_score_kind") == "BOOLEAN") & (F.col("_score_text") == "true")
    valid = usable & F.coalesce(is_integer | is_true, F.lit(False))
    number = F.coalesce(F.col("_score_text").try_cast("int"), F.lit(1))
    return (
        typed.withColumn("score_valid", valid)
        .withColumn("score", F.when(F.col("score_valid"), number).otherwise(F.lit(c.FALLBACK_SCORE)))
        .drop("_score", "_score_kind", "_score_text")
    )


def normalize_comment(validated: DataFrame) -> DataFrame:
    """Add `comment`: the evaluator's comment or the fixed text that stands in for it."""
    reply, reply_kind = F.col("reply"), F.col("reply_kind")
    typed = validated.withColumn("_comment", strict_json.field(reply, "comment")).withColumns(
        {
            "_comment_kind": strict_json.kind(F.col("_comment")),
            "_comment_text": F.col("_comment").cast("string"),
        }
    )
    kind, value = F.col("_comment_kind"), F.col("_comment_text")
    missing = F.col("_comment").isNull()
    spoken = F.when(missing, F.lit("")).otherwise(_spoken(kind, value))
    plain = F.when(_is_falsy(kind, value), F.lit(c.COMMENT_ABSENT)).otherwise(spoken)
    comment = (
        F.when(_invalid(reply_kind, reply), F.lit(c.COMMENT_INVALID_REPLY))
        .when((reply_kind == "OBJECT") & F.col("score_valid"), F.col("_plain"))
        .when(reply_kind == "OBJECT", F.concat(F.lit(c.COMMENT_BAD_SCORE_PREFIX), F.col("_spoken")))
    )
    blank = F.when(text.is_blank(F.col("_plain")), F.lit(c.COMMENT_BLANK)).otherwise(F.col("_plain"))
    return (
        typed.withColumns({"_spoken": spoken, "_plain": plain})
        .withColumn("_plain", blank)
        .withColumn("comment", comment)
        .drop("_comment", "_comment_kind", "_comment_text", "_spoken", "_plain")
    )


def _failure_text(reply_kind: Column) -> Column:
    """Error text for replies whose JSON value is not an object."""
    scalar = c.ERROR_REPLY_SCALAR
    return (
        F.when(reply_kind == "MISSING", F.lit(c.ERROR_REPLY_MISSING))
        .when(reply_kind == "ARRAY", F.lit(c.ERROR_REPLY_LIST))
        .when(reply_kind == "STRING", F.lit(c.ERROR_REPLY_STRING))
        .when(reply_kind == "VOID", F.lit(scalar.format("NoneType")))
        .when(reply_kind == "BOOLEAN", F.lit(scalar.format("bool")))
        .when(reply_kind == "BIGINT", F.lit(scalar.format("int")))
        .otherwise(F.lit(scalar.format("float")))
    )


def evaluation_fallback(commented: DataFrame) -> DataFrame:
    """Add `evaluation_status` and `error`; replies that cannot be read fail with score 1.

    An optional `request_error` column marks requests that failed outright.
    """
    request_error = (
        F.col("request_error") if "request_error" in commented.columns else F.lit(None).cast("string")
    )
    readable = F.col("reply_kind").isin("OBJECT", "INVALID") & request_error.isNull()
    error = F.when(~readable, F.coalesce(request_error, _failure_text(F.col("reply_kind"))))
    return (
        commented.withColumn("error", error)
        .withColumn("evaluation_status", F.when(readable, "success").otherwise("failed"))
        .withColumn("score", F.when(readable, F.col("score")).otherwise(F.lit(c.FALLBACK_SCORE)))
        .withColumn(
            "comment",
            F.when(readable, F.col("comment")).otherwise(
                F.concat(F.lit(c.COMMENT_EVALUATION_FAILED_PREFIX), F.col("error"))
            ),
        )
    )


def evaluate_replies(replies: DataFrame) -> DataFrame:
    """The whole chain from raw reply text to score, comment and status."""
    return evaluation_fallback(normalize_comment(validate_score(parse_evaluation(replies)))).drop(
        "reply", "reply_kind", "score_valid", "request_error"
    )


def join_evaluation(conversations: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each conversation with its evaluation; conversations without one keep NULLs."""
    wanted = evaluations.select("session_id", "score", "comment", "evaluation_status")
    return conversations.join(wanted, "session_id", "left")


def whole_transcripts(parts: DataFrame) -> DataFrame:
    """One text per session from its transcript parts, in order.

    A request to an evaluator is one text whatever the number of messages and the order of
    speakers; cut conversations first (`cut_at_end`), which bounds them by their turns.
    """
    pieces = F.array_sort(F.collect_list(F.struct("part", "transcript")))
    return parts.groupBy("session_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["transcript"]), "").alias("transcript")
    )


def evaluator_request(transcripts: DataFrame, prompt: str) -> DataFrame:
    """The two chat messages of an evaluation request, one row per session.

    `transcripts(session_id, part, transcript)` as `transcript_text` returns them.
    """

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(message("system", F.lit(prompt)), message("user", F.col("transcript")))
    return whole_transcripts(transcripts).select("session_id", messages.alias("messages"))


def _named(conversations: DataFrame) -> DataFrame:
    index = F.col("conversation_index").cast("string")
    return conversations.select(
        "conversation_index",
        F.coalesce("session_id", F.concat(F.lit("unknown_"), index)).alias("session_id"),
        F.coalesce("scenario", F.lit("unknown")).alias("scenario"),
        "transcript",
    )


def evaluate_batch(conversations: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """Ask `judge` about every transcript, then read its replies.

    `conversations(conversation_index, session_id, scenario, transcript)`, one row each with
    its whole transcript (`whole_transcripts`); a judge that raises fails only its own
    conversation.  Runs where the rows are, batch by batch.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = [], []
            for transcript in frame["transcript"]:
                try:
                    replies.append(judge(transcript))
                    errors.append(None)
                except Exception as error:  # one failure never stops the rest
                    replies.append(None)
                    errors.append(str(error))
            yield frame.drop(columns="transcript").assign(raw=replies, request_error=errors)

    named = _named(conversations)
    replies = named.mapInPandas(
        ask,
        "conversation_index BIGINT, session_id STRING, scenario STRING, raw STRING,"
        " request_error STRING",
    )
    return evaluate_replies(replies)


REPLIES = "session_id STRING, digest STRING, raw STRING, request_error STRING"


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """One reply per session and digest of what was asked; an answer wins over a failed request."""
    replies = spark.read.schema(REPLIES).parquet(path) if Folder(spark, path).files() else spark.createDataFrame([], REPLIES)
    best = F.max_by(F.struct("raw", "request_error"), F.struct(F.col("request_error").isNull(), "raw"))
    return replies.groupBy("session_id", "digest").agg(best.alias("_r")).select("session_id", "digest", "_r.*")


def evaluate_stored(
    conversations: DataFrame,
    judge: Callable[[str], str],
    path: str,
    prompt: str = "",
    in_flight: int = 4,
    task_rows: int = 200,
    retry_failed: bool = False,
    answered: Accumulator | None = None,
) -> DataFrame:
    """`evaluate_batch` that goes on where it was stopped: replies are kept under `path`.

    A reply belongs to a session and the digest of prompt and transcript, so a changed prompt or transcript is
    asked anew, and equal requests of one session once.  Only requests without a stored reply are made.  Each
    task asks about `task_rows` sessions, at most `in_flight` at a time, and its replies are kept as soon as it ends, whether
    or not the run does: what a killed run asks again is what its unfinished tasks had asked.
    Failed requests count as replies unless `retry_failed` is set.  `answered`, an accumulator, counts
    replies of finished tasks.
    """

    def ask_one(transcript: str) -> tuple[str | None, str | None]:
        try:
            return judge(transcript), None
        except Exception as error:  # one failure never stops the rest
            return None, str(error)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for frame in frames:
                replies = list(pool.map(ask_one, frame["transcript"]))
                if answered is not None:
                    answered.add(len(replies))
                raw, errors = zip(*replies) if replies else ((), ())
                yield frame.drop(columns="transcript").assign(raw=list(raw), request_error=list(errors))

    spark = conversations.sparkSession
    named = _named(conversations).withColumn(
        "digest", F.sha2(F.concat_ws("\x00", F.lit(prompt), F.coalesce("transcript", F.lit(""))).cast("binary"), 256)
    )
    known = stored_replies(spark, path)
    if retry_failed:
        known = known.filter(F.col("request_error").isNull())
    requests = named.groupBy("session_id", "digest").agg(F.min("transcript").alias("transcript"))
    pending = requests.join(known.select("session_id", "digest"), ["session_id", "digest"], "left_anti")
    n = pending.count()
    if n:
        writer = pending.repartition(-(-n // task_rows), "session_id", "digest").mapInPandas(ask, REPLIES).write.mode("append")
        # finished tasks move their files into place themselves, so these outlive a run that fails
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    replies = named.drop("transcript").join(stored_replies(spark, path), ["session_id", "digest"], "left")
    return evaluate_replies(replies.drop("digest"))


def evaluation_summary(evaluations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals, mean score over all evaluations, distribution and success rate."""
    total = F.count("*")
    successful = F.count_if(F.col("evaluation_status") == "success")
    score = F.coalesce("score", F.lit(c.FALLBACK_SCORE))
    return evaluations.groupBy(*keys).agg(
        total.alias("total_evaluations"),
        successful.alias("successful_evaluations"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
        *[F.count_if(score == s).alias(f"score_{s}") for s in c.VALID_SCORES],
        numbers.ratio_or_zero(successful, total).alias("success_rate"),
    )
