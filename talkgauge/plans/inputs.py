"""Conversation-evaluation tables derived by Spark from the given base tables.

They give every operator realistic input with its edge cases: rows without a scenario,
failed rows without a duration, a status outside the two counted ones, unlisted models,
failed evaluations and ten shapes of evaluator replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.operators import blocks, conversations, costs
from talkgauge.session import prepare_session

FIRST_SPEAKER = "client"
MARKERS = {"agent_markers": ("end",), "client_markers": ("und",)}

# Known schemas, so that opening a table starts no job.
BASE_TABLES = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
        " props STRING"
    ),
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
        " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
        " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
        " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
        " p_retailprice DOUBLE"
    ),
}


class Inputs:
    """The derived tables over one folder of base tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare_session(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def _stream(self, name: str) -> DataFrame:
        """A table as a stream; the pattern matches a single file and a folder of files."""
        reader = self.spark.readStream.schema(BASE_TABLES[name])
        return reader.parquet(f"{self.folder}/{name}.parquet*")

    def event_stream(self) -> DataFrame:
        return self._stream("events")

    def message_stream(self) -> DataFrame:
        rows = self._messages(self._stream("conversations"))
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))

    def messages(self) -> DataFrame:
        """Message rows, about 20 seconds apart."""
        return self._messages(self.table("conversations"))

    def _messages(self, rows: DataFrame) -> DataFrame:
        return rows.selectExpr(
            "conv_id",
            "concat('conv-', cast(conv_id AS STRING)) AS session_id",
            "turn AS msg_index",
            "CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'client' ELSE 'system' END"
            " AS speaker",
            "text AS content",
            "timestampadd(SECOND, conv_id * 37 + turn * 20 + conv_id * turn % 13,"
            " TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts",
        )

    def numbered(self) -> DataFrame:
        return conversations.number_turns(self.messages(), FIRST_SPEAKER)

    def sessions(self) -> DataFrame:
        """One row per conversation with the sizes the other tables are made of."""
        return self.table("conversations").groupBy("conv_id").agg(
            F.expr("count_if(role = 'assistant') AS agent_msgs"),
            F.expr("sum(length(text)) AS n_chars"),
            F.expr("concat('conv-', cast(conv_id AS STRING)) AS session_id"),
        )

    def results(self) -> DataFrame:
        """Result rows in four batches; the events give the start times."""
        starts = self.table("events").selectExpr("event_id AS conv_id", "ts")
        sized = self.sessions().withColumn(
            "duration", F.expr("CASE WHEN conv_id % 11 <> 5 THEN cast(n_chars AS DOUBLE) / 8 END")
        )
        return sized.join(starts, "conv_id", "left").selectExpr(
            "session_id",
            "conv_id AS scenario_index",
            "concat('batch-', cast(conv_id % 4 AS STRING)) AS batch_id",
            "CASE WHEN conv_id % 19 <> 18 THEN concat('scenario_', cast(conv_id % 7 AS STRING)) END"
            " AS scenario",
            "CASE WHEN conv_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS prompt_version",
            "cast(conv_id % 3 AS INT) AS seed",
            "CASE WHEN conv_id % 11 = 5 THEN 'failed' WHEN conv_id % 23 = 22 THEN 'running'"
            " ELSE 'completed' END AS status",
            "CASE WHEN conv_id % 11 = 5 OR conv_id % 13 = 4 THEN 1"
            " ELSE cast(1 + n_chars % 3 AS INT) END AS score",
            "CASE conv_id % 6 WHEN 0 THEN 'say \"hi\", ok' WHEN 1 THEN concat('two', chr(10), 'lines')"
            " WHEN 3 THEN r'back\\slash' WHEN 4 THEN 'Привет, мир'"
            " WHEN 5 THEN concat('cr', chr(13), chr(10), 'lf') END AS comment",
            "CASE WHEN conv_id % 11 = 5 THEN NULL WHEN conv_id % 13 = 4 THEN 'failed'"
            " ELSE 'success' END AS evaluation_status",
            "CASE WHEN conv_id % 17 <> 3 THEN cast(agent_msgs AS INT) END AS total_turns",
            "duration AS duration_seconds",
            "ts AS start_time",
            "timestampadd(MICROSECOND, cast(duration * 1000000 AS BIGINT), ts) AS end_time",
        )

    def token_log(self) -> DataFrame:
        """Usage of every request: all earlier text is the prompt, the message the reply."""
        sized = self.messages().where("speaker <> 'system'").selectExpr(
            "conv_id", "session_id", "msg_index", "ts", "length(content) AS n"
        )
        spoken = blocks.running_total(
            sized, ["conv_id"], "msg_index", F.col("n"), "earlier", include_current=False
        )
        return spoken.selectExpr(
            "conv_id",
            "session_id",
            "msg_index",
            "ts AS timestamp",
            "CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'gpt-3.5-turbo'"
            " WHEN 3 THEN 'gpt-4o-mini' ELSE 'unlisted' END AS model",
            "earlier div 4 AS prompt_tokens",
            "cast(n div 4 AS BIGINT) AS completion_tokens",
            "earlier div 4 + n div 4 AS total_tokens",
        )

    def usage(self) -> DataFrame:
        return costs.request_cost(self.token_log(), costs.price_table(self.spark))

    def replies(self) -> DataFrame:
        """One raw evaluator reply per conversation, in ten shapes."""
        return self.sessions().selectExpr(
            "conv_id",
            "session_id",
            """CASE conv_id % 10 WHEN 0 THEN '{"score":3,"comment":"ok"}'
               WHEN 1 THEN '{"score":2,"comment":"fine"}'
               WHEN 2 THEN '{"score":1,"comment":"bad"}'
               WHEN 3 THEN '{"score":2.0,"comment":"float"}'
               WHEN 4 THEN '{"score":"3","comment":"text"}'
               WHEN 5 THEN '{"score":5,"comment":"range"}'
               WHEN 6 THEN '{"error":"e","score":3}'
               WHEN 7 THEN 'not json'
               WHEN 8 THEN '[1,2]'
               ELSE '{"score":3,"comment":"  "}' END AS raw""",
        )

    def jobs(self) -> DataFrame:
        """One batch job per event."""
        kinds = self.table("events").selectExpr(
            "*",
            "CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'failed'"
            " WHEN 3 THEN 'cancelled' ELSE 'pending' END AS status",
            "event_id % 9 + 1 AS total",
        )
        sized = kinds.selectExpr(
            "*", "CASE WHEN status IN ('completed', 'failed') THEN total ELSE total % 3 END AS done"
        )
        return sized.selectExpr(
            "concat('batch-', cast(event_id AS STRING)) AS batch_id",
            "status",
            "ts AS created_at",
            "CASE WHEN status <> 'pending' THEN timestampadd(SECOND, 5, ts) END AS started_at",
            "CASE WHEN status IN ('completed', 'failed', 'cancelled')"
            " THEN timestampadd(SECOND, 65, ts) END AS completed_at",
            "total AS total_scenarios",
            "done AS completed_scenarios",
            "cast(if(status = 'failed', 1, 0) AS BIGINT) AS failed_scenarios",
            "100 * done / total AS progress_percentage",
            "CASE WHEN status = 'failed' THEN 'stopped' END AS error_message",
        )

    def scenarios(self) -> DataFrame:
        """The scenario list of each batch; some entries have no name."""
        return self.results().selectExpr(
            "batch_id",
            "scenario_index",
            "CASE WHEN scenario_index % 5 <> 0"
            " THEN concat('named_', cast(scenario_index % 7 AS STRING)) END AS name",
        )

    def attempts(self) -> tuple[DataFrame, DataFrame]:
        """(conversations, exceptions): scenarios that ran, and those that raised instead."""
        rows = self.results()
        error = (
            "CASE WHEN status = 'failed' AND scenario_index % 2 = 0"
            " THEN concat('lost ', cast(scenario_index AS STRING)) END AS error"
        )
        ran = rows.where("scenario_index % 9 <> 8").selectExpr("*", error)
        exceptions = rows.where("scenario_index % 9 = 8").selectExpr(
            "batch_id",
            "scenario_index",
            "concat('boom ', cast(scenario_index AS STRING)) AS error",
        )
        return ran, exceptions

    def event_usage(self, events: DataFrame) -> DataFrame:
        """Events as token usage: the type is the model, the value in cents the tokens."""
        tokens = "cast(round(value * 100) AS BIGINT)"
        return events.selectExpr(
            "ts",
            "event_type AS model",
            f"{tokens} AS total_tokens",
            f"cast({tokens} * 0.0001BD AS DECIMAL(18,10)) AS cost_estimate",
        )
