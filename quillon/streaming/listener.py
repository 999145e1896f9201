"""Telemetry of streams: a listener that keeps the progress of queries as rows of a table, and metrics observed on the way."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "run_id string, name string, batch long, at string, rows long, rows_per_s double, batch_ms long, state_rows long, metrics map<string,double>"


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """df, whose rows are measured as they pass: each metric is an aggregate, reported for every micro-batch."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])


class Telemetry(StreamingQueryListener):
    """A row for each micro-batch of the session's streams, appended to a folder whenever `every` rows have come and when a
    query ends; so at most `every` rows are held. Metrics that are no numbers are left out. Use it as a context manager."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 100):
        self.spark, self.folder, self.every = spark, folder, every
        self._rows: list[tuple] = []
        self._lock, self._ended, self._over = threading.Lock(), set(), threading.Condition()

    def __enter__(self) -> Telemetry:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {f"{n}.{k}": v for n, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        numbers = {k: float(v) for k, v in found.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        state = sum(s.numRowsTotal for s in p.stateOperators)
        with self._lock:
            self._rows.append((str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), p.batchDuration, state, numbers))
            full = len(self._rows) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        with self._over:
            self._ended.add(str(event.runId))
            self._over.notify_all()

    def wait(self, query, seconds: float = 60) -> bool:
        """Waits until all there is to know of a query that has ended has come in."""
        with self._over:
            return self._over.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """All rows, those that are still held included."""
        self.flush()
        return self.spark.read.schema(PROGRESS).parquet(self.folder)


def latest(query) -> dict | None:
    """The last progress of a query as a plain dictionary."""
    return json.loads(query.lastProgress.json) if query.lastProgress else None
