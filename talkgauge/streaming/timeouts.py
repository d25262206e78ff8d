"""The time limit of conversations, read before each exchange, on a stream of all their messages.

The rule is that of `cut_at_timeout`: when an exchange is about to start, the time from the first message
to the previous one is compared with the limit, strictly.  Messages come out of order; those of a
session wait in its state until the watermark has passed them, since then none before them can come.
Then they go through the clock in order and only the clock stays.  State per session is therefore the
clock, the messages of the last `delay`, and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkgauge import constants as c

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CUTS = "session_id string, cut_index bigint, started bigint, previous bigint"


class ExchangeClock(StatefulProcessor):
    """One session's clock.  Times are microseconds; timers and watermarks milliseconds."""

    def __init__(self, limit_us: int, idle_ms: int) -> None:
        self._limit, self._idle = limit_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._clock = handle.getValueState("clock", "started bigint, previous bigint, decided boolean")
        self._waiting = handle.getMapState("waiting", "msg_index bigint", "at bigint, opens boolean")
        self._timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at_ms: int) -> None:
        """Have one timer, at this time."""
        if self._timer.exists():
            before = self._timer.get()[0]
            if before == at_ms:
                return
            self._handle.deleteTimer(before)
        self._handle.registerTimer(at_ms)
        self._timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:  # without a session: such rows only move the watermark
            return iter([])
        decided = self._clock.exists() and self._clock.get()[2]
        times = []
        for row in rows:
            if row.msg_index is None or row.at is None:
                continue
            times.append(-(-row.at // 1000))
            if not decided:
                self._waiting.updateValue((row.msg_index,), (row.at, row.opens))
        if not times:
            return iter([])
        timer = self._timer.get()[0] if self._timer.exists() else None
        if decided:  # remembered until it has been silent for long enough
            self._wake(max(timer or 0, max(times) + self._idle))
        else:  # what waits is due before any idle timer
            first = min(at for at, _ in self._waiting.values())
            self._wake(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((index[0], at, opens) for index, (at, opens) in self._waiting.iterator())
        started, previous, decided = self._clock.get() if self._clock.exists() else (None, None, False)
        found, left, last = [], [], previous
        for index, at, opens in waiting:
            last = at if last is None else max(last, at)
            if at > passed * 1000:
                left.append(at)
                continue
            self._waiting.removeKey((index,))
            if decided:
                continue
            if started is not None and opens and previous - started > self._limit:
                found.append(Row(session_id=key[0], cut_index=index, started=started, previous=previous))
                decided = True
            started, previous = at if started is None else started, at
        if decided:  # nothing more is asked of this session
            self._waiting.clear()
            left = []
        idle = -(-last // 1000) + self._idle
        if left:
            if started is not None:
                self._clock.update((started, previous, decided))
            self._wake(-(-min(left) // 1000))
        elif idle > passed:
            self._clock.update((started, previous, decided))
            self._wake(idle)
        else:  # silent for long enough
            self._clock.clear()
        return iter(found)

    def close(self) -> None:
        pass


def stream_exchange_timeout(
    messages: DataFrame,
    first_speaker: str = "agent",
    delay: str = "10 minutes",
    timeout_seconds: float = c.TIMEOUT_SECONDS,
    idle_seconds: float = 3600,
) -> DataFrame:
    """The sessions that `cut_at_timeout` cuts, as soon as the watermark has passed the cut.

    `messages(session_id, msg_index, speaker, ts)` is a stream of all messages, in any order; `ts` does
    not fall with `msg_index`.  Returns session_id, cut_index (the first message that is not kept),
    started_at and elapsed_seconds.  A session is forgotten when the watermark is `idle_seconds` past
    its last message; later messages of it start anew.  Rows without a session, index or time only move the
    watermark.  The query needs the RocksDB state store (`run_stateful`).
    """
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    opens = F.coalesce(F.col("speaker") == first_speaker, F.lit(False)).alias("opens")
    rows = timed.select("session_id", "msg_index", "ts", F.unix_micros("ts").alias("at"), opens)
    clock = ExchangeClock(int(timeout_seconds * 1_000_000), int(idle_seconds * 1000))
    cuts = rows.groupBy("session_id").transformWithState(clock, _CUTS, "Append", "EventTime")
    elapsed = (F.col("previous") - F.col("started")) / F.lit(1_000_000)
    return cuts.select(
        "session_id",
        "cut_index",
        F.timestamp_micros("started").alias("started_at"),
        elapsed.alias("elapsed_seconds"),
    )


def run_stateful(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str):
    """Append to files what a stream with keyed state gives for all that has arrived; the ended query."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
