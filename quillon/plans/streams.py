"""Streams over the tables, run to their end: what they hold then equals a query over the whole table.

Each is fed in PARTS parts by time, one part a micro-batch, and ends when all has been read; windows that no later row has closed are not
in the result, nor in the SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import scratch
from ..sources.readers import table
from ..streaming import listener, state, streams
from .registry import Registry

plans = Registry()

PARTS, FILE = 3, 1 << 14


def _feed(rows: DataFrame, order: str) -> DataFrame:
    """rows as a stream of PARTS parts by ranges of a column, written one after the other, each in equally many files of at least FILE rows (one
    file if a part has fewer)."""
    spark, path = rows.sparkSession, scratch.folder(rows.sparkSession, "feed")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    span = (high - low) / PARTS
    inside = [(F.col(order) >= F.lit(low + k * span)) & (F.lit(k == PARTS - 1) | (F.col(order) < F.lit(low + (k + 1) * span))) for k in range(PARTS)]
    files = max(1, min(spark.sparkContext.defaultParallelism, min(rows.agg(*[F.count_if(i) for i in inside]).first()) // FILE))
    for part in inside:
        own = rows.where(part)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
    return streams.files(spark, path, rows.schema, files)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


@contextmanager
def _started(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, in no more partitions than there are cores, as streams don't merge small ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        with state.rocksdb(spark):
            yield
    finally:
        spark.conf.set(key, before)


def _appended(df: DataFrame) -> DataFrame:
    """All rows that a stream appends."""
    spark, path = df.sparkSession, scratch.folder(df.sparkSession, "out")
    with _started(spark):
        streams.drained(df, path, scratch.folder(spark, "checkpoint"))
    return spark.read.schema(df.schema).parquet(path)


def _updated(df: DataFrame, key: list[str], mode: str = "update", idle: bool = True) -> DataFrame:
    """The last row of each key that a stream gives."""
    spark, path = df.sparkSession, scratch.folder(df.sparkSession, "out")
    with _started(spark):
        streams.each_batch(df, lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/b{n}"), scratch.folder(spark, "checkpoint"), mode, idle)
    rest = [c for c in df.columns if c not in key]
    held = spark.read.schema(StructType([*df.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/b*")
    last = held.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


_CLOSED = "(SELECT max(ts) FROM events)"


@plans.query(f"""WITH e AS (SELECT event_id, user_id AS key, ts, time_bucket(INTERVAL 1 DAY, ts) AS d FROM events)
SELECT key, event_id, place, place <= 3 AS allowed FROM (SELECT key, event_id, d, row_number() OVER (PARTITION BY key, d ORDER BY ts, event_id) AS place FROM e) WHERE d + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Three events a user and day are allowed: rows wait in list state, timers of the event time decide."""
    return _appended(state.rate_limited(_events(spark, sf), "user_id", 3, 86_400_000))


@plans.query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}),
c AS (SELECT key, event_id, n, ts AS last, true AS acts FROM e WHERE n = 1 UNION ALL
      SELECT e.key, e.event_id, e.n, CASE WHEN e.ts - c.last >= INTERVAL 12 HOUR THEN e.ts ELSE c.last END, e.ts - c.last >= INTERVAL 12 HOUR FROM c JOIN e ON e.key = c.key AND e.n = c.n + 1)
SELECT key, event_id, acts FROM c""")
def stream_cool_down(spark: SparkSession, sf: str) -> DataFrame:
    """An event acts if twelve hours have gone by since its user's last that acted."""
    return _appended(state.cooled_down(_events(spark, sf), "user_id", 12 * 3_600_000))


@plans.query("SELECT conv_id AS key, count(*) AS parts, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'AI: ' END || replace(coalesce(text, ''), chr(10), '') || ' | ', '' ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def stream_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that grow turn by turn, in list state with a time to live."""
    fed = _feed(table(spark, sf, "conversations"), "turn").select(F.col("conv_id").alias("key"), "turn", "role", "text")
    return _updated(state.talks(fed), ["key"], idle=False)


@plans.query(f"SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of six hours as they close."""
    found = _appended(streams.tumbling(_events(spark, sf), "6 hours", "0 seconds", "event_type"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plans.query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def stream_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _events(spark, sf).select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("status"))
    return _updated(streams.latest_status(keyed), ["key"])


@plans.query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each user and type of event, within a watermark that none outlives."""
    keyed = _events(spark, sf).withColumn("k", F.concat_ws(":", "user_id", "event_type"))
    return _appended(streams.deduplicated(keyed, "k", "365 days")).select("user_id", "event_type")


@plans.query("SELECT count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents, max(event_id) AS last, count(*) FILTER (event_type = 'error') AS errors FROM events")
def stream_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics observed in every micro-batch, as the listener has written them, over all batches."""
    fed = listener.observed(_events(spark, sf), "seen", n=F.count("*"), cents=F.sum(F.round(F.col("value") * 100).cast("long")), last=F.max("event_id"), errors=F.count_if(F.col("event_type") == "error"))
    with listener.Telemetry(spark, scratch.folder(spark, "telemetry")) as told:
        query = fed.writeStream.format("noop").option("checkpointLocation", scratch.folder(spark, "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        told.wait(query)
        rows = told.table().where(F.col("run_id") == str(query.runId)).where("rows > 0")
    metric = lambda k: F.col("metrics")[f"seen.{k}"].cast("long")
    return rows.agg(*[F.sum(metric(k)).alias(k) for k in ("n", "cents")], F.max(metric("last")).alias("last"), F.sum(metric("errors")).alias("errors"))
