"""Request rates against a limit: per calendar second, and for any span of one second.

For the second form a request counts in its own calendar second and in the next one, so that whatever lies
within a second before a request is in the request's own bucket.  Requests of one instant are counted
first: a bucket has at most as many rows as two seconds have microseconds, whatever the traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgauge import constants as c

_SECOND_US = 1_000_000


def stream_request_rate(
    requests: DataFrame, at: str = "ts", limit: int = c.REQUESTS_PER_SECOND_LIMIT, delay: str = "10 minutes"
) -> DataFrame:
    """Requests per calendar second and whether they exceed the limit; a second is final once the watermark passed it."""
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return (
        timed.groupBy(F.window(at, "1 second"))
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("window.start").alias("second"), "requests", (F.col("requests") > limit).alias("over_limit")
        )
    )


def counts_by_instant(requests: DataFrame, at: str = "ts", delay: str | None = None) -> DataFrame:
    """(bucket, at, requests): requests per instant, in the bucket of their second and in the next.

    On a stream, `delay` sets the watermark on the bucket, so that all rows of a bucket are final at once.
    """
    second = F.date_trunc("second", F.col(at).cast("timestamp"))
    buckets = F.array(second, second + F.expr("INTERVAL 1 SECOND"))
    rows = requests.where(F.col(at).isNotNull()).select(
        F.explode(buckets).alias("bucket"), F.col(at).cast("timestamp").alias("at")
    )
    if delay is not None:
        rows = rows.withWatermark("bucket", delay)
    return rows.groupBy("bucket", "at").agg(F.count("*").alias("requests"))


def peaks(counts: DataFrame, limit: int = c.REQUESTS_PER_SECOND_LIMIT) -> DataFrame:
    """Per calendar second with requests: their number, and the most within one second up to any of them.

    `counts` are those of `counts_by_instant`, whole buckets.  `busy_requests` are those up to which more than the limit came
    within one second (the second's start excluded).
    """
    last_second = (
        Window.partitionBy("bucket").orderBy(F.unix_micros("at")).rangeBetween(-_SECOND_US + 1, 0)
    )
    rated = counts.withColumn("rate", F.sum("requests").over(last_second))
    return (
        rated.where(F.col("at") >= F.col("bucket"))
        .groupBy(F.col("bucket").alias("second"))
        .agg(
            F.sum("requests").alias("requests"),
            F.max("rate").alias("peak"),
            F.sum(F.when(F.col("rate") > limit, F.col("requests")).otherwise(0)).alias("busy_requests"),
        )
        .withColumn("over_limit", F.col("peak") > limit)
    )


def request_peaks(requests: DataFrame, at: str = "ts", limit: int = c.REQUESTS_PER_SECOND_LIMIT) -> DataFrame:
    """`peaks` of a table of requests."""
    return peaks(counts_by_instant(requests, at), limit)


def run_request_peaks(
    spark: SparkSession,
    requests: DataFrame,
    path: str,
    checkpoint: str,
    at: str = "ts",
    limit: int = c.REQUESTS_PER_SECOND_LIMIT,
    delay: str = "10 minutes",
) -> DataFrame:
    """`peaks` of a stream, for all that has arrived; a second is written when the watermark passed its bucket.

    A bucket's rows are final in the same micro-batch, whose peaks go into a folder of its own; a repeated
    micro-batch overwrites it.
    """
    counts = counts_by_instant(requests, at, delay)

    def save(final: DataFrame, epoch: int) -> None:
        peaks(final, limit).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        counts.writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "second TIMESTAMP, requests BIGINT, peak BIGINT, busy_requests BIGINT, over_limit BOOLEAN"
    return spark.read.schema(schema).parquet(path).select("second", "requests", "peak", "busy_requests", "over_limit")
