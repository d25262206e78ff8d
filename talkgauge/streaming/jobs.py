"""Streaming forms of the log reports.

Each function takes a streaming DataFrame and returns one; `run_available` and
`run_upserts` drive a query over what has arrived and leave the result in files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.streaming import upserts


def stream_token_usage(
    usage: DataFrame, at: str = "ts", delay: str = "10 minutes", width: str = "1 minute"
) -> DataFrame:
    """Requests, tokens and cost per model and time window; later rows than `delay` are dropped."""
    window = F.window(at, width)
    return (
        usage.withWatermark(at, delay)
        .groupBy(window, "model")
        .agg(
            F.count("*").alias("requests"),
            F.sum("total_tokens").alias("tokens"),
            F.sum("cost_estimate").cast("decimal(28,10)").alias("cost"),
        )
        .select(F.col("window.start").alias("window_start"), "model", "requests", "tokens", "cost")
    )


def stream_batch_progress(results: DataFrame) -> DataFrame:
    """Completed and failed conversations per batch so far (update mode)."""
    return results.groupBy("batch_id").agg(
        F.count("*").alias("total_scenarios"),
        F.count_if(F.col("status") == "completed").alias("completed_scenarios"),
        F.count_if(F.col("status") == "failed").alias("failed_scenarios"),
    )


def stream_conversation_timeout(
    starts: DataFrame,
    completions: DataFrame,
    delay: str = "10 minutes",
    timeout_seconds: int = c.TIMEOUT_SECONDS,
) -> DataFrame:
    """Sessions without a completion record within the limit after their start.

    `starts(session_id, ts)` holds the first turn of each session, `completions(session_id,
    ts)` the completion records.  An outer join of the two streams, bounded in time, emits
    a session once the watermark has passed its limit; starts and completions that are
    decided leave the state by themselves.
    """
    started = starts.select("session_id", F.col("ts").alias("started_at")).withWatermark(
        "started_at", delay
    )
    done = completions.select(
        F.col("session_id").alias("_done_id"), F.col("ts").alias("_done_at")
    ).withWatermark("_done_at", delay)
    limit = F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    in_time = (
        (F.col("session_id") == F.col("_done_id"))
        & (F.col("_done_at") >= F.col("started_at"))
        & (F.col("_done_at") <= F.col("started_at") + limit)
    )
    return (
        started.join(done, in_time, "left_outer")
        .filter(F.col("_done_id").isNull())
        .select("session_id", "started_at", (F.col("started_at") + limit).alias("deadline"))
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, append finished rows to files, and read them back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_upserts(
    spark: SparkSession,
    stream: DataFrame,
    keys: list[str],
    path: str,
    checkpoint: str,
    buckets: int = upserts.BUCKETS,
) -> DataFrame:
    """Process what has arrived in update mode; the latest row of each key wins.

    Each micro-batch writes the keys it changed to an `UpsertLog`, which reads as the newest row of every key.  Keys are
    never dropped: leave out finished batches in the stream if they are without number.
    """
    log = upserts.UpsertLog(spark, path, stream.schema, keys, buckets)
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(log.write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log.read()
