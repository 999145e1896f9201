"""An embedding cache: vectors of even ids are cached, all ids are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import cache
from ..sources.readers import table
from .registry import Registry

plans = Registry()
_NOW = "2024-01-01 00:00:00"


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return cache.entries(rows.where("vec_id % 2 = 0"), "vec_id", "embedding", F.lit(_NOW).cast("timestamp"), "emb:")


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("key"))


@plans.query("SELECT vec_id, 'emb:' || vec_id AS key, CASE WHEN vec_id % 2 = 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = cache.get_many(_keys(spark, sf), _cache(spark, sf))
    return found.select("vec_id", "key", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@plans.query("SELECT vec_id, 'emb:' || vec_id AS key FROM embeddings WHERE vec_id % 2 = 0")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return cache.hits(_keys(spark, sf), _cache(spark, sf)).select("vec_id", "key")


@plans.query("SELECT vec_id, 'emb:' || vec_id AS key FROM embeddings WHERE vec_id % 2 <> 0")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return cache.misses(_keys(spark, sf), _cache(spark, sf)).select("vec_id", "key")


@plans.query("SELECT vec_id, vec_id % 2 = 0 AS hit, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def cache_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """Cached and computed vectors together, each beside its ordinal."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("key"), "embedding")
    found = cache.read_through(_keys(spark, sf), _cache(spark, sf), lambda keys: keys.join(rows, "key"))
    return found.select("vec_id", "hit", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@plans.query("SELECT count(*) FILTER (vec_id % 2 = 0) AS hits, count(*) FILTER (vec_id % 2 <> 0) AS misses, count(*) AS total, CAST(count(*) FILTER (vec_id % 2 = 0) AS DOUBLE) / count(*) AS hit_rate FROM embeddings")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = cache.get_many(_keys(spark, sf), _cache(spark, sf))
    return cache.stats(found, F.col("embedding").isNotNull())


@plans.query("SELECT event_type, count(*) FILTER (value > 10) AS hits, count(*) FILTER (NOT value > 10) AS misses, count(*) AS total, round(CAST(count(*) FILTER (value > 10) AS DOUBLE) / nullif(count(value), 0), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_stats_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    found = cache.stats(table(spark, sf, "events"), F.col("value") > 10, "event_type")
    return found.withColumn("hit_rate", F.round("hit_rate", 6))


@plans.query("SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events)")
def cache_alive(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose time to live is not over at the last event."""
    events = table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now), F.lit(True)).where("expires_at > now").select("event_id")  # one row


@plans.query("SELECT 'emb:' || vec_id AS key FROM embeddings WHERE vec_id % 2 = 0 AND starts_with('emb:' || vec_id, 'emb:1')")
def cache_namespace(spark: SparkSession, sf: str) -> DataFrame:
    return cache.in_namespace(_cache(spark, sf), "emb:1").select("key")


@plans.query("SELECT 'emb:' || vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def cache_put(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    old = _cache(spark, sf).withColumn("version", F.lit(1))
    fresh = cache.entries(rows.where("vec_id % 3 = 0"), "vec_id", "embedding", F.lit(_NOW).cast("timestamp"), "emb:").withColumn("version", F.lit(2))
    return cache.put(old, fresh).select("key", "version")


@plans.query("SELECT 'emb:' || vec_id AS key FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0")
def cache_delete(spark: SparkSession, sf: str) -> DataFrame:
    return cache.delete(_cache(spark, sf), _keys(spark, sf).where("vec_id % 3 = 0")).select("key")


@plans.query("SELECT item_id, 'b:' || CASE WHEN length(text) > 100 THEN md5(text) ELSE text END AS key, 'text:' || text || ':m:True' AS composite FROM benchmark")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.cache_key("text", "b:").alias("key"), T.composite_key("text", "text", "m", True).alias("composite"))


@plans.query("SELECT d.doc_id, e.vec_id IS NOT NULL AS found, round(coalesce(CAST(e.embedding[1] AS DOUBLE), 0), 6) AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def cache_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their vector, or zeros."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select("doc_id", F.col("vec_id").isNotNull().alias("found"), F.round(F.get(V.zeros_for_null("embedding", 64), F.lit(0)), 6).alias("first"))
