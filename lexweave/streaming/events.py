"""Streaming forms of the state operators: rate limits, caches, memory, ticks and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lexweave.operators.state import LIMIT, WINDOW_SECONDS


def read_events(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A stream of Parquet events with ``ts`` as a zoned timestamp, for watermarks refuse the zone-less kind."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and value by type and event-time window; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events by user and session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "1 day") -> DataFrame:
    """Decision for each event of a user as it comes, by the times within the window.

    The state of a user holds the times of one window alone; refused events count too, and an idle user's state
    expires with the watermark. Events of one batch are taken in time order, ties by id.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"]):
            now = ts.value // 1000
            times = [t for t in times if t >= now - seconds * 1_000_000] + [now]
            allowed = len(times) <= limit
            out.append((key[0], event_id, len(times), allowed, None if allowed else max(1, int(seconds - (now - min(times)) / 1_000_000))))
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["user_id", "event_id", "n_in_window", "allowed", "retry_after"])
        yield frame.astype({"retry_after": "Int64"})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, n_in_window int, allowed boolean, retry_after long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def memory_stream(events: DataFrame, lines: int = 10) -> DataFrame:
    """The last ``lines`` event types of each user, updated with every batch."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        kept = (old + rows["event_type"].tolist())[-lines:]
        state.update((kept,))
        yield pd.DataFrame({"user_id": [key[0]], "lines": [kept]})

    return events.groupBy("user_id").applyInPandasWithState(keep, "user_id long, lines array<string>", "lines array<string>", "update", GroupStateTimeout.NoTimeout)


def hot_update(changes: DataFrame, apply, folder: str, interval: str | None = None):
    """Applies every batch of changes by ``apply(batch, batch_id)``, each minute or once over what is there."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", folder)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
