"""Keyed state with lists, maps and timers: rate limits, cool-downs, growing transcripts.

All need the RocksDB state store; `rocksdb` sets it while queries start. Decisions that depend on the order of rows are made when a timer
of the event time fires, over all rows of a key in the windows that have closed, in order of (ts, event_id), so the order of arrival decides nothing.
What a key waits for lies in list state, to which rows are appended; nothing is rewritten but by the timer that ends it, or by its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that wait for a timer, those of a batch in one entry, and what a decision is made of.
_ROWS = "us array<long>, ids array<long>"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class _Waiting(StatefulProcessor):
    """Holds the rows of a key until the windows they fall into have closed, and hands over in order, at once, those of all windows closed.

    A batch sets one timer, for the first window of its rows, and the timer that fires decides all windows closed by then and sets one for the first
    that is open, so rows are read and written once a batch, however many windows it closes. The rows of a batch are one entry of the list."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROWS)

    def ends(self, us: np.ndarray) -> np.ndarray:
        return (us // (self.width * 1000) + 1) * self.width

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["us"].to_numpy(np.int64), p["event_id"].to_numpy(np.int64)) for p in rows if len(p)]
        if parts:
            us, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.rows.appendValue((us.tolist(), ids.tolist()))
            self.handle.registerTimer(int(self.ends(us).min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = list(self.rows.get())
        if not held:
            return
        us, ids = (np.concatenate([np.asarray(r[k], np.int64) for r in held]) for k in (0, 1))
        ends = self.ends(us)
        done = ends <= closed
        if not done.any():
            return
        if done.all():
            self.rows.clear()
        else:
            self.rows.put([(us[~done].tolist(), ids[~done].tolist())])
            self.handle.registerTimer(int(ends[~done].min()))
        us, ids = us[done], ids[done]
        order = np.lexsort((ids, us))
        yield from self.closed(key[0], us[order], ids[order])

    def closed(self, key, us: np.ndarray, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RateLimit(_Waiting):
    """The first `most` rows of a key in each window are allowed."""

    def __init__(self, width_ms: int, most: int):
        super().__init__(width_ms)
        self.most = most

    def closed(self, key, us, ids):
        ends = self.ends(us)
        place = np.arange(len(ends)) - np.searchsorted(ends, ends) + 1
        yield pd.DataFrame({"key": [key] * len(ids), "event_id": ids, "place": place, "allowed": place <= self.most})


class CoolDown(_Waiting):
    """A row acts if at least `pause` has gone by since the last row of its key that acted."""

    def __init__(self, width_ms: int, pause_ms: int):
        super().__init__(width_ms)
        self.pause = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long")

    def closed(self, key, us, ids):
        last, acts = (self.last.get()[0] if self.last.exists() else None), []
        for now in us.tolist():
            acts.append(last is None or now - last >= self.pause * 1000)
            last = now if acts[-1] else last
        self.last.update((last,))
        yield pd.DataFrame({"key": [key] * len(ids), "event_id": ids, "acts": acts})


def _keyed(df: DataFrame, key: str, late: str):
    rows = df.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    return rows.where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).groupBy("key")


def rate_limited(df: DataFrame, key: str, most: int, width_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """key, event_id, place (from 1) in its window and allowed of a stream (key, ts, event_id), as windows of event time close. Rows
    without a key or time are left out. late: how long a window waits for rows."""
    if most < 0 or width_ms < 1:
        raise ValueError("most must be at least 0, width_ms at least 1")
    return _keyed(df, key, late).transformWithStateInPandas(RateLimit(width_ms, most), f"key {dict(df.dtypes)[key]}, event_id long, place long, allowed boolean", "append", "EventTime")


def cooled_down(df: DataFrame, key: str, pause_ms: int, width_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """key, event_id and acts of a stream (key, ts, event_id), as windows of event time close; what acted last is carried from window to window."""
    if pause_ms < 0 or width_ms < 1:
        raise ValueError("pause_ms must be at least 0, width_ms at least 1")
    return _keyed(df, key, late).transformWithStateInPandas(CoolDown(width_ms, pause_ms), f"key {dict(df.dtypes)[key]}, event_id long, acts boolean", "append", "EventTime")


class Talk(StatefulProcessor):
    """What was said in a conversation, in list state that ends `ttl_ms` after a part was said."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "turn long, role string, text string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.said.appendList([tuple(None if pd.isna(x) else x for x in r) for r in part[["turn", "role", "text"]].itertuples(index=False)])
        said = sorted(self.said.get(), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        text = "".join(("User: " if who == "user" else "AI: ") + (t or "").replace("\n", "") + " | " for _, who, t in said)
        yield pd.DataFrame({"key": [key[0]], "parts": [len(said)], "transcript": [text]})

    def close(self) -> None:
        pass


def talks(df: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """key, parts and transcript of a stream (key, turn, role, text), whenever a conversation grows; parts older than ttl_ms are forgotten."""
    return df.groupBy("key").transformWithStateInPandas(Talk(ttl_ms), f"key {dict(df.dtypes)['key']}, parts long, transcript string", "update", "processingTime")
