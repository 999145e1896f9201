"""Statistics of embeddings and of text outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def embedding_quality(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """Over all elements of all vectors (by group): mean, population deviation, least, greatest, share of zeros; and the mean norm."""
    rows = df.where(F.col(vec).isNotNull()).select(*keys, V.norm(vec).alias("size"), V.doubles(vec).alias("v"))
    sums = rows.select(
        *keys,
        "size",
        F.size("v").alias("n"),
        V.total("v").alias("s"),
        V.dot("v", "v").alias("ss"),
        F.array_min("v").alias("low"),
        F.array_max("v").alias("high"),
        F.size(F.filter("v", lambda x: x == 0)).alias("zeros"),
    )
    mean = F.sum("s") / F.sum("n")
    return sums.groupBy(*keys).agg(
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.avg("size").alias("avg_norm"),
        (F.sum("zeros") / F.sum("n")).alias("zero_fraction"),
    )


def exploding(high: Column | str = "max", low: Column | str = "min") -> Column:
    high, low = (F.col(x) if isinstance(x, str) else x for x in (high, low))
    return (F.abs(high) > 100) | (F.abs(low) > 100)


def vanishing(std: Column | str = "std", zeros: Column | str = "zero_fraction") -> Column:
    std, zeros = (F.col(x) if isinstance(x, str) else x for x in (std, zeros))
    return (std < 0.01) | (zeros > 0.5)


def vector_stats(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Per row: mean, sample deviation, least, greatest and the entropy of the elements."""
    return df.select(key, V.mean(vec).alias("mean"), V.std(vec, sample=True).alias("std"), F.array_min(V.doubles(vec)).alias("min"), F.array_max(V.doubles(vec)).alias("max"), V.entropy(vec).alias("entropy"))


def text_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: how many texts, mean, least and greatest length, and how many report an error. Null texts don't count; no texts: zeros."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    size = F.char_length("value")
    return long.groupBy("field").agg(
        F.count("value").alias("n"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_length"),
        F.count(F.when(T.is_error("value"), 1)).alias("errors"),
    )


def length_matrix(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Lengths by row and field; errors and nulls: 0."""
    return df.select(key, *[F.coalesce(F.when(T.is_error(f), 0).otherwise(F.char_length(f)), F.lit(0)).alias(f) for f in fields])


def row_stats(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Per row: least, greatest, mean and population deviation."""
    return df.select(key, F.array_min(V.doubles(vec)).alias("min"), F.array_max(V.doubles(vec)).alias("max"), V.mean(vec).alias("mean"), V.std(vec).alias("std"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """bin (from 1) and n of a number column in equal bins; the greatest value falls into the last bin."""
    place = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)) + 1
    return df.where(F.col(value).between(low, high)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def vector_columns(df: DataFrame, suffixes: tuple[str, ...] = ("_img_embedding", "_txt_embedding", "_embedding")) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def output_columns(df: DataFrame, prefixes: tuple[str, ...] = ("llava_", "qwen_")) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes) and not c.endswith("_embedding")]
