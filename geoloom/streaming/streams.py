"""Streaming counterparts: quality gate, dataset retention, run sessions, departure boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from geoloom.operators.quality import feature_findings

DEFAULT_TTL_DAYS = 30


def gate_stream(features: DataFrame, good_path: str, findings_path: str, checkpoint: str, key: str, geom: str = "geom",
                **trigger) -> StreamingQuery:
    """Sound features to one table, problems of the others to another; each micro-batch is written once.

    A batch lands in a folder of its own number and is overwritten when it is replayed, so a restart repeats nothing.
    """
    checked = features.withColumn("findings", feature_findings(features, geom))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good = batch.where(F.size("findings") == 0).drop("findings")
        bad = batch.where(F.size("findings") > 0).select(key, F.explode("findings").alias("message"))
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{findings_path}/batch={batch_id}")
        batch.unpersist()

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


class _Retention(StatefulProcessor):
    """Last use per dataset; an event-time timer reports its expiry when no touch arrives for its retention time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("use", "last bigint, ttl bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        got = self.state.get() if self.state.exists() else None
        last, ttl = (got[0], got[1]) if got else (None, None)
        for pdf in rows:
            top = int(pdf["ts_ms"].max())
            if last is None or top >= last:
                last = top
                days = pdf.loc[pdf["ts_ms"] == top, "ttl_days"].dropna()
                ttl = int(days.iloc[-1]) if len(days) else (ttl if ttl is not None else DEFAULT_TTL_DAYS)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.state.update((last, ttl))
        self.handle.registerTimer(last + ttl * 86_400_000)
        yield pd.DataFrame({"dataset": [key[0]], "last_used_ms": [last], "event": ["used"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        last, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"dataset": [key[0]], "last_used_ms": [last], "event": ["expired"]})

    def close(self) -> None:
        pass


def touch_ttl_stream(touches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``touches(dataset, ts, ttl_days)`` to ``(dataset, last_used_ms, event)`` with ``used`` and ``expired`` events.

    State is one row per dataset. Needs the RocksDB state store provider.
    """
    t = touches.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts")).select("dataset", "ts", "ts_ms", "ttl_days")
    return t.groupBy("dataset").transformWithStateInPandas(
        _Retention(), "dataset string, last_used_ms bigint, event string", outputMode="Append", timeMode="EventTime")


def last_use_stream(touches: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Last use per dataset and day without custom state: a windowed maximum that also combines before the shuffle."""
    t = touches.withWatermark("ts", delay)
    return t.groupBy(F.window("ts", window), "dataset").agg(F.max("ts").alias("last_used"), F.max("ttl_days").alias("ttl_days")).select(
        "dataset", F.col("window.start").alias("day"), "last_used", "ttl_days")


def run_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", idle: str = "10 minutes",
                 delay: str = "30 minutes") -> DataFrame:
    """Sessions per run closed by idle time: call count, first and last event, and total value. Replayed events count once.

    Works on a stream (append mode) and, as its batch twin, on a table.
    """
    e = events
    if e.isStreaming:
        e = e.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])
    else:
        e = e.dropDuplicates([event_id])
    s = e.groupBy(F.session_window(ts, idle).alias("s"), key).agg(
        F.count("*").alias("calls"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.sum("value").alias("total"))
    return s.select(key, "calls", "first", "last", "total")


def departure_board(events: DataFrame, stop: str = "stop_id", ts: str = "ts", window: str = "1 hour", slide: str | None = "15 minutes",
                    delay: str = "30 minutes") -> DataFrame:
    """Departures per stop in tumbling or sliding windows with the mean headway; late rows are dropped on a stream."""
    e = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    n = F.count("*")
    return e.groupBy(w.alias("w"), stop).agg(
        n.alias("departures"), F.when(n > 1, span / 60e6 / (n - 1)).alias("mean_headway")).select(
        stop, F.col("w.start").alias("start"), "departures", "mean_headway")
