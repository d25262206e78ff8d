"""Token usage, prices and cost reports.

Cost is linear in tokens, so usage is summed per key before it meets prices or
batches; joins only see one row per (session, model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import numbers

COST = "DECIMAL(18,10)"


def price_table(spark: SparkSession) -> DataFrame:
    """The price list: a handful of fixed rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                F.lit(given).cast("DECIMAL(12,8)").alias("input_per_1k"),
                F.lit(made).cast("DECIMAL(12,8)").alias("output_per_1k"),
            )
            for model, given, made in c.PRICES_PER_1K
        ]
    )
    return spark.range(1).select(F.inline(rows))


def price_lookup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the prices of each row's model; NULL where the model is not listed.

    No broadcast is forced: Spark measures the price list and broadcasts it when small.
    """
    return usage.join(prices, "model", "left")


def _cost() -> Column:
    cost = (
        F.col("prompt_tokens") * F.col("input_per_1k")
        + F.col("completion_tokens") * F.col("output_per_1k")
    ) * F.lit("0.001").cast("DECIMAL(4,3)")
    return F.coalesce(cost, F.lit(0)).cast(COST)


def request_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add `cost_estimate` in dollars; models without a price cost 0."""
    return (
        price_lookup(usage, prices)
        .withColumn("cost_estimate", _cost())
        .drop("input_per_1k", "output_per_1k")
    )


def session_usage(usage: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Usage summed per session (or other keys), combined on the map side."""
    return usage.groupBy(*keys).agg(
        F.sum("cost_estimate").cast("DECIMAL(28,10)").alias("cost"),
        F.sum("total_tokens").alias("tokens"),
        F.count("*").alias("requests"),
    )


def usage_by_batch(usage: DataFrame, results: DataFrame) -> DataFrame:
    """Usage per batch: sessions are summed first, then attached to their batch."""
    sessions = results.filter(F.col("session_id").isNotNull()).select("session_id", "batch_id")
    per_session = session_usage(usage)
    return (
        per_session.join(sessions.distinct(), "session_id")
        .groupBy("batch_id")
        .agg(
            F.sum("cost").cast("DECIMAL(28,10)").alias("cost"),
            F.sum("tokens").alias("tokens"),
            F.sum("requests").alias("requests"),
        )
    )


def _report(totals: DataFrame, key: str) -> DataFrame:
    cost = F.coalesce(F.col("cost"), F.lit(0)).cast("DECIMAL(28,10)")
    requests = F.coalesce("requests", F.lit(0))
    mean = F.when(requests > 0, cost.cast("double") / requests).otherwise(F.lit(0.0))
    return totals.select(
        key,
        F.round(cost, 4).cast("DECIMAL(22,4)").alias("total_cost_usd"),
        F.coalesce("tokens", F.lit(0)).alias("total_tokens"),
        requests.alias("total_requests"),
        numbers.round_half_even(mean, 4).alias("average_cost_per_request"),
    )


def cost_report(usage: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Cost, tokens and requests of every batch in `batches`; zeros where none were logged."""
    totals = batches.select("batch_id").distinct().join(
        usage_by_batch(usage, results), "batch_id", "left"
    )
    return _report(totals, "batch_id")


def cost_by_model(usage: DataFrame) -> DataFrame:
    return _report(session_usage(usage, ("model",)), "model")
