"""Transcripts that keep arriving: refreshes on a clock or line by line, and live gap detection.

`refresh_stream` looks for changed files and reads their sessions again whole; `append_stream` follows
each file from where it was read to and takes up just its new lines. Gap detection keeps a thread's last
call and those that a late one may still come before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sessionlake.functions.context import rebuilt_context
from sessionlake.operators.gaps import IDLE_SECONDS, MIN_REBUILT_PCT, MIN_REBUILT_TOKENS
from sessionlake.sources.store import Store, append, refresh
from sessionlake.sources.tail import line_stream


def refresh_stream(
    spark: SparkSession, store: Store, root: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Looks at a root again and again and refreshes what changed: new files and grown ones alike.

    A file source knows a file by its path only and would miss a transcript that grows, so the
    stream is only the clock; the fingerprints of `refresh` find what to read. With `every` the
    query runs on at that interval, without it once.
    """
    ticks = (
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    )

    def on_tick(batch: DataFrame, _: int) -> None:
        refresh(store, root)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        ticks.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def append_stream(
    spark: SparkSession, store: Store, root: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Takes up new lines as they are written, a batch at a time. The log of what was read lies beside the
    checkpoint. A batch that is run again changes nothing: the store knows how far each file was read."""
    lines = line_stream(spark, root, f"{checkpoint.rstrip('/')}-lines")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        lines.writeStream.foreachBatch(lambda batch, _: append(store, root, batch) and None)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


GAP = (
    "session_id STRING, source STRING, gap_start BIGINT, started_at BIGINT, "
    "idle_seconds BIGINT, reloaded BOOLEAN, rebuilt_tokens BIGINT, cached_1h BOOLEAN"
)
GAP_NAMES = [part.split()[0] for part in GAP.split(", ")]


#: A thread is forgotten this long after its last call, in milliseconds of event time.
FORGET_AFTER = 30 * 24 * 3600 * 1000


class GapDetector(StatefulProcessor):
    """Reports the silence before each call once nothing can come in between any more.

    Calls wait in state, by time and index, until the watermark has passed them; then they are taken in
    order, whatever order they came in, and compared with the last one taken before. What waits is
    what one thread calls within the time that lateness is allowed. A call that comes twice waits once.
    Times are microseconds since the epoch, so no worker's time zone plays a part.
    """

    def __init__(self, min_idle_seconds: int = IDLE_SECONDS, forget_after: int = FORGET_AFTER) -> None:
        self.min_idle_seconds, self.forget_after = min_idle_seconds, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at BIGINT, cached BOOLEAN")
        self.waiting = handle.getMapState(
            "waiting", "at BIGINT, index INT", "reloaded BOOLEAN, tokens BIGINT, cached BOOLEAN"
        )

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond that is not before a call."""
        return -(-at // 1000)

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object
    ) -> Iterator[pd.DataFrame]:
        due = set()
        for some in rows:
            members = (some["at"], some["index"], some["reloaded"], some["cache_creation_tokens"], some["cached"])
            for at, index, reloaded, tokens, cached in zip(*members, strict=True):
                self.waiting.updateValue((int(at), int(index)), (bool(reloaded), int(tokens), bool(cached)))
                due.add(self._due(int(at)))
        for moment in due:
            self.handle.registerTimer(moment)
        return iter([])

    def handleExpiredTimer(  # noqa: N803, as Spark names them
        self, key: tuple, timerValues: object, expiredTimerInfo: object
    ) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted(k for k in self.waiting.keys() if self._due(k[0]) <= now)
        held, found = self.last.get(), []
        for at, index in ready:
            reloaded, tokens, cached = self.waiting.getValue((at, index))
            self.waiting.removeKey((at, index))
            if held is not None:
                # Whole seconds on either side, as the batch report counts them.
                idle = at // 1_000_000 - held[0] // 1_000_000
                if idle >= self.min_idle_seconds:
                    found.append((*key, held[0], at, idle, reloaded, tokens, held[1]))
            held = (at, cached)
        if ready:
            self.last.update(held)
            self.handle.registerTimer(self._due(held[0]) + self.forget_after)
        elif held is not None and self._due(held[0]) + self.forget_after <= now and not self.waiting.exists():
            self.last.clear()
        yield pd.DataFrame(found, columns=GAP_NAMES)

    def close(self) -> None:
        pass


def idle_gap_stream(
    calls: DataFrame,
    min_idle_seconds: int = IDLE_SECONDS,
    min_rebuilt_tokens: int = MIN_REBUILT_TOKENS,
    min_rebuilt_pct: int = MIN_REBUILT_PCT,
    late: str = "1 hour",
    forget_after: int = FORGET_AFTER,
) -> DataFrame:
    """Silences as they become certain, from a stream of calls with the columns of the archive.

    Calls may come in any order within `late` of the latest seen: the rows are those of the batch
    report. Later ones are left out, as everywhere behind a watermark. A thread whose last call is older
    than `forget_after` milliseconds starts anew."""
    narrow = calls.withWatermark("started_at", late).select(
        "session_id", "source", "started_at", F.unix_micros("started_at").alias("at"), "index",
        "cache_creation_tokens",
        rebuilt_context(
            F.col("cache_creation_tokens"), F.col("cache_read_tokens"), min_rebuilt_tokens,
            min_rebuilt_pct,
        ).alias("reloaded"),
        (F.coalesce("cache_1h_tokens", F.lit(0)) > 0).alias("cached"),
    ).filter(F.col("at").isNotNull())
    found = narrow.groupBy("session_id", "source").transformWithStateInPandas(
        statefulProcessor=GapDetector(min_idle_seconds, forget_after), outputStructType=GAP,
        outputMode="Append", timeMode="EventTime",
    )
    return found.withColumns({c: F.timestamp_micros(c) for c in ("gap_start", "started_at")})


def call_windows(calls: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls and cost per session and window of time, closed once nothing later than `late` is due."""
    return (
        calls.withWatermark("started_at", late)
        .groupBy("session_id", F.window("started_at", width).alias("window"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    )


def call_sessions(calls: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of calls of a thread with no silence longer than `gap` inside."""
    return (
        calls.withWatermark("started_at", late)
        .groupBy("session_id", "source", F.session_window("started_at", gap).alias("burst"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    )
