"""Structured Streaming: sources, windows, read-through caches, latest status, transcripts, keyed values with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.rules import ratio
from ..functions.vectors import normalize
from ..sources.cache_table import BucketedCache


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


#: Whether Spark plans batches without data. State that expires by processing time asks for one after
#: another, so a stream of it over all there is ends only without them.
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drained(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is into a Parquet folder, and ends."""
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", idle: bool = True, limit: float | None = None) -> None:
    """Runs work on every micro-batch of all there is, and ends. idle=False: no batches without data, needed with state
    that expires by processing time. limit: seconds after which the stream is stopped and TimeoutError raised."""
    conf = df.sparkSession.conf
    before = conf.get(_IDLE, "true")
    conf.set(_IDLE, str(idle and before == "true").lower())
    try:  # a query takes the setting as it is when it starts
        query = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(_IDLE, before)
    if not query.awaitTermination(limit) and limit is not None:
        query.stop()
        raise TimeoutError(f"the stream was not done after {limit} s")


def until(df: DataFrame, rows: int, work: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs work on micro-batches until `rows` rows have been handed over, the last batch cut to what is left, and stops; the number of rows
    handed over, which is less where the stream ends first."""
    seen = 0

    def step(batch: DataFrame, number: int) -> None:
        nonlocal seen
        if seen < rows:
            part = batch.limit(rows - seen).persist()
            try:
                n = part.count()
                work(part, number)
            finally:
                part.unpersist()
            seen += n

    query = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive and seen < rows:
        query.awaitTermination(0.2)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return seen


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(df: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """start, by, n, total and mean of the values of each window, as it closes."""
    out = _timed(df, late).groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total", ratio(F.col("total"), F.col("n")).alias("mean"))


def sliding(df: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    out = _timed(df, late).groupBy(F.window("ts", width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    out = _timed(df, late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def deduplicated(df: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(df, late).dropDuplicatesWithinWatermark([key])


class Latest(StatefulProcessor):
    """The latest status of a key by (ts, event_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", "ts timestamp, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.held.get() if self.held.exists() else None
        for part in rows:
            for r in part.itertuples():
                now = (r.ts.to_pydatetime(), int(r.event_id), r.status)
                if best is None or now[:2] > (best[0].replace(tzinfo=None), best[1]):
                    best = now
        self.held.update(best)
        yield pd.DataFrame({"key": [key[0]], "status": [best[2]]})

    def close(self) -> None:
        pass


def latest_status(df: DataFrame) -> DataFrame:
    """key and status of a stream (key, ts, event_id, status), whenever they change. Needs the RocksDB state store."""
    return df.groupBy("key").transformWithStateInPandas(Latest(), "key long, status string", "update", "none")


class Expiring(StatefulProcessor):
    """The last value of a key while it is fresh."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("value", "value string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, total, value = 0, 0, None
        for part in rows:
            for v in part["value"]:
                total += 1
                hits += self.held.exists()
                value = v
                self.held.update((v,))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "lookups": [total], "value": [value]})

    def close(self) -> None:
        pass


def expiring(df: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """key, hits, lookups and value of a stream (key, value): a lookup hits if the key's value has not expired."""
    return df.groupBy("key").transformWithStateInPandas(Expiring(ttl_ms), "key long, hits long, lookups long, value string", "update", "processingTime")


def read_through(spark: SparkSession, keys: DataFrame, cache: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """For each micro-batch of keys (key), appends what the cache folder (key, embedding, batch) lacks. A batch that is
    repeated after a failure replaces its own part, so nothing is written twice."""

    def work(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("key string, embedding array<double>, batch long").parquet(cache).where(F.col("batch") < number) if _there(spark, cache) else spark.createDataFrame([], "key string, embedding array<double>, batch long")
        fresh = compute(batch.select("key").distinct().join(known, "key", "left_anti"))
        fresh.select("key", "embedding").write.mode("overwrite").parquet(f"{cache}/batch={number}")

    each_batch(keys, work, checkpoint)


def read_through_table(keys: DataFrame, cache: BucketedCache, compute: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """For each micro-batch of keys (key), adds what the bucketed cache lacks, without moving a cached row. compute gives key and
    embedding of keys. A batch that is repeated after a failure finds what it wrote, so nothing is written twice."""

    def work(batch: DataFrame, number: int) -> None:
        cache.put(compute(cache.missing(batch)).withColumn("at", F.current_timestamp()))

    each_batch(keys, work, checkpoint)


def indexed(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> None:
    """Encodes every micro-batch and adds key, embedding at length 1 and batch to the folder, which search reads as a table. A
    repeated batch replaces its own part."""

    def work(batch: DataFrame, number: int) -> None:
        encode(batch).select("key", normalize("embedding").alias("embedding")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    each_batch(stream, work, checkpoint)


def coalesced(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, max_wait_ms: int = 100) -> StreamingQuery:
    """A running stream whose requests wait at most max_wait_ms before those that came meanwhile are worked on together; the caller stops it."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max_wait_ms} milliseconds").start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and len(fs.listStatus(where)) > 0


def transcripts(df: DataFrame) -> DataFrame:
    """key and transcript of a stream (key, turn, role, text), as conversations grow (update mode)."""
    said = F.struct("turn", F.when(F.col("role") == "user", "User: ").otherwise("AI: ").alias("who"), F.replace("text", F.lit("\n"), F.lit("")).alias("said"))
    parts = F.transform(F.sort_array(F.collect_list(said)), lambda x: F.concat(x["who"], x["said"], F.lit(" | ")))
    return df.groupBy("key").agg(F.array_join(parts, "").alias("transcript"))


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of the last micro-batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_s": p.get("processedRowsPerSecond", 0.0)} for p in query.recentProgress]
