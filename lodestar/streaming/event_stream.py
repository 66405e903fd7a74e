"""The event queries as Structured Streaming, with the same results as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.guard import INTERVAL_S, SCHEMA, State, follow
from lodestar.plans.events_log import points

LATE = "1 day"
WINDOW_S, REQUESTS = 60, 120


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Stream of the event files of a folder; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("epoch", F.unix_timestamp("ts"))


def tumbling(events: DataFrame, size: str = "6 hours") -> DataFrame:
    """Events and values by window and type; rows later than LATE are dropped."""
    rows = events.withWatermark("ts", LATE).groupBy(F.window("ts", size), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


def scores(events: DataFrame) -> DataFrame:
    """Running threat score of every key (for output modes complete and update)."""
    return events.groupBy("user_id").agg(F.sum(points()).alias("score"), F.max("epoch").alias("last_seen"))


def anchored_limit(events: DataFrame, window_s: int = WINDOW_S, requests: int = REQUESTS) -> DataFrame:
    """Per batch and key: requests allowed and denied, in windows that begin at a key's first request after the last. A
    key's state goes once the watermark (LATE behind the newest event) is past its window."""

    def limit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (-1, 0)
        allowed = denied = 0
        for epoch in sorted(e for pdf in frames for e in pdf["epoch"].tolist()):
            if start < 0 or epoch - start >= window_s:
                start, used = epoch, 0
            used += 1
            allowed, denied = (allowed + 1, denied) if used <= requests else (allowed, denied + 1)
        state.update((start, used))
        state.setTimeoutTimestamp(max((start + window_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "denied": [denied]})

    return events.withWatermark("ts", LATE).groupBy("user_id").applyInPandasWithState(
        limit, "user_id long, allowed long, denied long", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout
    )


class Guard(StatefulProcessor):
    """State of one key in value state, and a timer at the time at which it ends by itself."""

    def __init__(self, interval: int) -> None:
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "score long, logins long, attacks long, last long, until long")

    def _kept(self) -> State | None:
        return State(*self.state.get()) if self.state.exists() else None

    def _frame(self, key: tuple, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=["user_id", "at", "kind", "score", "until"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, changes = self._kept(), []
        before = state.ends(self.interval) if state else None
        came = [r for pdf in rows for r in pdf[["epoch", "event_id", "event_type", "points"]].itertuples(index=False, name=None)]
        for at, _, kind, points in sorted(came):
            state, made = follow(state, at, points, kind, self.interval)
            changes += made
        self.state.update(tuple(state))
        if before is not None:
            self.handle.deleteTimer(before * 1000)
        self.handle.registerTimer(state.ends(self.interval) * 1000)
        yield from self._frame(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._kept()
        if state is not None:
            self.state.clear()
            yield from self._frame(key, [state.end(self.interval)])

    def close(self) -> None:
        pass


def guard_states(events: DataFrame, interval: int = INTERVAL_S, late: str = LATE) -> DataFrame:
    """The changes of guard_changes as they happen: a key that nothing comes from is forgotten, and a ban released, once the
    watermark is past that time, and then no state of the key is left. Needs the RocksDB state store."""
    rows = events.withColumn("points", points()).where("points > 0 and user_id is not null").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Guard(interval), SCHEMA, "append", "eventTime")
