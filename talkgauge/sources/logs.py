"""Append-only logs: token usage, conversations, service messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import schemas
from talkgauge.functions import strict_json
from talkgauge.sources.results import TIMESTAMPS

# Fixed pattern: time - logger - level - message[ - {json}]
_SERVICE_HEAD = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - (\w+) - (.*?)(?: - (\{.*\}))?$"
)
_ATTEMPT = r"\(attempt (\d+)/(\d+)\)"


def parse_token_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Token records from log lines; a line that does not parse is skipped.

    The record is everything after the first `" - "`.  A missing cost or token count is 0.
    """
    record = strict_json.parse_strict(F.get(F.split(F.col(text), " - ", 2), F.lit(1)))
    rows = lines.select(record.alias("_r")).filter(strict_json.kind(F.col("_r")) == "OBJECT")

    def value(name: str, type_name: str) -> Column:
        return strict_json.field(F.col("_r"), name, type_name)

    return rows.select(
        value("session_id", "string").alias("session_id"),
        value("model", "string").alias("model"),
        F.coalesce(value("prompt_tokens", "bigint"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(value("completion_tokens", "bigint"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(value("total_tokens", "bigint"), F.lit(0)).alias("total_tokens"),
        F.coalesce(value("cost_estimate", "decimal(18,10)"), F.lit(0))
        .cast("decimal(18,10)")
        .alias("cost_estimate"),
        value("timestamp", "string").try_cast("timestamp_ntz").alias("timestamp"),
    )


def read_token_log(spark: SparkSession, path: str) -> DataFrame:
    """Token usage from the `tokens_*` files of a log folder."""
    return parse_token_lines(spark.read.text(f"{path.rstrip('/')}/tokens_*"))


def read_conversation_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turn records, completion records) of conversation logs.

    Completion records carry `event_type`; turn records do not.  A line that does not parse
    is skipped, as in token logs.
    """
    reader = spark.read.schema(schemas.CONVERSATION_LOG).option("timestampNTZFormat", TIMESTAMPS)
    lines = reader.option("columnNameOfCorruptRecord", "_broken").json(path)
    records = lines.filter(F.col("_broken").isNull())
    turns = records.filter(F.col("event_type").isNull()).select(
        "session_id", "turn_number", "role", "content", "tool_calls", "tool_results", "timestamp"
    )
    completions = records.filter(F.col("event_type") == "conversation_complete").select(
        "session_id", "total_turns", "final_score", "evaluator_comment", "status", "timestamp"
    )
    return turns, completions


def messages_from_log(turns: DataFrame) -> DataFrame:
    """Turn records as message rows: the agent speaks first in every exchange."""
    index = F.col("turn_number").cast("bigint") * 2 - F.when(F.col("role") == "agent", 2).otherwise(1)
    return turns.select(
        "session_id",
        index.alias("msg_index"),
        F.col("role").alias("speaker"),
        "content",
        F.col("timestamp").alias("ts"),
    )


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    """Application and error lines; lines of tracebacks are left out.

    `attempt` and `attempts` are filled for retry messages.
    """
    line = F.col("value")

    def part(number: int) -> Column:
        return F.regexp_extract(line, _SERVICE_HEAD, number)

    def attempt(number: int) -> Column:
        return F.regexp_extract("message", _ATTEMPT, number).try_cast("int")

    return (
        spark.read.text(path)
        .filter(line.rlike(_SERVICE_HEAD))
        .select(
            F.translate(part(1), ",", ".").try_cast("timestamp_ntz").alias("ts"),
            part(2).alias("logger"),
            part(3).alias("level"),
            part(4).alias("message"),
            F.nullif(part(5), F.lit("")).alias("extra"),
        )
        .withColumn("attempt", attempt(1))
        .withColumn("attempts", attempt(2))
    )


def count_levels(service_log: DataFrame) -> DataFrame:
    """Messages per level, and how many of them report a retry."""
    return service_log.groupBy("level").agg(
        F.count("*").alias("n"), F.count_if(F.col("attempt").isNotNull()).alias("retries")
    )
