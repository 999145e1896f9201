"""A keyed embedding cache as a table: key, embedding, expires_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TTL_SECONDS = 86_400


def entries(df: DataFrame, key: str, vec: str, now: Column, namespace: str = "", ttl: int = TTL_SECONDS) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(T.cache_key(F.col(key).cast("string"), namespace).alias("key"), F.col(vec).alias("embedding"), (now + F.make_interval(secs=F.lit(ttl))).alias("expires_at"))


def alive(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh entries in the place of old ones of the same key."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def in_namespace(cache: DataFrame, namespace: str) -> DataFrame:
    """Entries of a namespace: a prefix filter that reaches the scan."""
    return cache.where(F.col("key").startswith(namespace))


def flush(cache: DataFrame, namespace: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(namespace))


def get_many(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Every asked key with its embedding, or null."""
    return keys.join(cache.select("key", "embedding"), "key", "left")


def hits(keys: DataFrame, cache: DataFrame) -> DataFrame:
    return keys.join(cache, "key", "left_semi")


def misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    return keys.join(cache, "key", "left_anti")


def read_through(keys: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """key, embedding and hit for every asked key: what is cached, and what compute makes of the rest (key -> key, embedding).
    Asked keys keep their other columns, an ordinal among them."""
    found = keys.join(cache.select("key", "embedding"), "key").withColumn("hit", F.lit(True))
    made = misses(keys, cache)
    fresh = compute(made.select("key").distinct())
    return found.unionByName(made.join(fresh.select("key", "embedding"), "key").withColumn("hit", F.lit(False)))


def _rate() -> Column:
    return F.coalesce(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses")).cast("double")), F.lit(0.0))


def _counts(hit: Column | str) -> list[Column]:
    hit = F.col(hit) if isinstance(hit, str) else hit
    return [F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"), F.count("*").alias("total")]


def stats(lookups: DataFrame, hit: Column | str = "hit", *by: str) -> DataFrame:
    """hits, misses, total and hit_rate (0 without lookups)."""
    return lookups.groupBy(*by).agg(*_counts(hit)).withColumn("hit_rate", _rate())


def overview(lookups: DataFrame, key: str, at: str, hit: Column | str = "hit") -> DataFrame:
    """stats with keys, the number of distinct keys, and uptime_s, the whole seconds from the first lookup to the last (0 without any)."""
    first, last = (F.unix_micros(f(F.col(at).cast("timestamp"))) for f in (F.min, F.max))
    uptime = F.coalesce(F.floor((last - first) / 1000000), F.lit(0))
    return lookups.agg(*_counts(hit), F.count_distinct(key).alias("keys"), uptime.alias("uptime_s")).withColumn("hit_rate", _rate())
