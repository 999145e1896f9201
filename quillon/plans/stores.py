"""Tables that go through the library's own sources and stores and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import events, scratch
from ..sources.cache_table import BucketedCache
from ..sources.readers import table
from .registry import Registry

plans = Registry()


def _lines(spark: SparkSession, sf: str) -> str:
    """The events as JSON lines, their ids as payloads, in a folder."""
    path = scratch.folder(spark, "events")
    media = F.struct(F.base64(F.col("event_id").cast("string").cast("binary")).alias("payload"))
    rows = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("streamSid"), F.col("props").alias("text"), media.alias("media"))).alias("value"))
    rows.repartition(5).write.text(path)
    spark.dataSource.register(events.EventSource)
    return path


def _read(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("payload").cast("string").cast("long").alias("event_id"), F.col("stream").cast("long").alias("user_id"), F.col("event").alias("event_type"), F.col("text").alias("props"))


@plans.query("SELECT event_id, user_id, event_type, props FROM events")
def json_event_source(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark.read.format("json_events").option("suffix", ".txt").option("files_per_task", 2).load(_lines(spark, sf)))


@plans.query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def json_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder as a stream that is run to its end."""
    fed, out = spark.readStream.format("json_events").option("suffix", ".txt").option("files_per_task", 2).load(_lines(spark, sf)), scratch.folder(spark, "out")
    query = _read(fed).writeStream.format("parquet").option("checkpointLocation", scratch.folder(spark, "checkpoint")).trigger(once=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@plans.query("SELECT CAST(d.doc_id AS VARCHAR) AS key, e.vec_id IS NOT NULL AS hit, CASE WHEN e.label = 1 THEN -CAST(e.embedding[1] AS DOUBLE) ELSE CAST(e.embedding[1] AS DOUBLE) END AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label <> 2")
def bucketed_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document looked up in a bucketed cache of vectors: rows of label 2 are too old, those of label 1 were written again."""
    cache = BucketedCache(spark, f"cache_{uuid.uuid4().hex}", scratch.folder(spark, "cache"), 8)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding", F.when(F.col("label") == 2, F.lit("2024-01-01")).otherwise(F.lit("2024-01-03")).cast("timestamp").alias("at"), "label")
    cache.put(rows)
    cache.put(rows.where("label = 1").select("key", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit("2024-01-04").cast("timestamp").alias("at")))
    found = cache.lookup(table(spark, sf, "documents").select(F.col("doc_id").alias("key")), "2024-01-02")
    return found.select("key", "hit", F.col("embedding")[0].alias("first"))
