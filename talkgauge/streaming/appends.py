"""Log records as a stream, appended to daily folders exactly once.

Each micro-batch has a folder of its own inside each day, `log_date=.../epoch=...`, and overwrites just those.
A run that ends between writing and committing is repeated with the same records into the same
folders, so no reader, of whatever kind, finds a second copy.  Folders appear whole, by rename, and
may be read at any time; a day is pruned by its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from talkgauge.sources.results import TIMESTAMPS


def start_append_logs(
    records: DataFrame, path: str, checkpoint: str, at: str = "timestamp", **trigger: bool | str
) -> StreamingQuery:
    """Start appending a stream of log records as JSON lines; by default, all that has arrived.

    A record without a time goes to the folder that Spark names for null.  Pass a trigger such as
    `processingTime="1 minute"` for a query that goes on.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        dated = batch.withColumn("log_date", F.to_date(at)).withColumn("epoch", F.lit(epoch).cast("long"))
        writer = dated.hint("rebalance", "log_date").write.partitionBy("log_date", "epoch")
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("timestampNTZFormat", TIMESTAMPS).json(path)

    return (
        records.writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_appended_logs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records appended so far, with `log_date` and `epoch`."""
    fields = [f for f in schema.fields if f.name not in ("log_date", "epoch")]
    whole = StructType([*fields, StructField("log_date", DateType()), StructField("epoch", LongType())])
    return spark.read.schema(whole).option("timestampNTZFormat", TIMESTAMPS).json(path)
