"""Writers: snapshots, collections with a checked vector width, metrics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import upsert


def snapshot(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """df as parquet (zstd), orc, json or csv with a header."""
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """A text column as lines of text files."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def widths(df: DataFrame) -> dict[str, int]:
    """The vector columns of df, and the length of the first vector of each; columns without a vector are left out."""
    named = [c for c, t in df.dtypes if t in ("array<float>", "array<double>")]
    if not named:
        return {}
    found = df.agg(*[F.first(F.when(F.col(c).isNotNull(), F.size(c)), ignorenulls=True).alias(c) for c in named]).first()
    return {c: found[c] for c in named if found[c] is not None}


class Collection:
    """Points (id, named vectors, payload) in a Parquet folder; generations make a replacement atomic for its readers. Without given
    widths a new collection takes those of the first vectors it is created from, and one that is there those it holds."""

    def __init__(self, spark: SparkSession, path: str, vectors: dict[str, int] | None = None):
        self.spark, self.path = spark, path
        self.vectors = vectors if vectors is not None or not self.exists() else widths(self.read())

    def _fit(self, df: DataFrame) -> DataFrame:
        """Rows whose vectors all have the collection's widths; a null vector is allowed."""
        if self.vectors is None:
            self.vectors = widths(df)
        for name, size in self.vectors.items():
            df = df.where(F.col(name).isNull() | (F.size(name) == size))
        return df

    def _current(self) -> int:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(p.getName()[1:]) for p in found if p.getName()[0] == "g" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=-1)

    def create(self, df: DataFrame) -> None:
        """Starts anew with df."""
        if self.vectors is None:
            self.vectors = widths(df)
        self._fit(df).write.parquet(f"{self.path}/g{self._current() + 1}")

    def exists(self) -> bool:
        return self._current() >= 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/g{self._current()}")

    def upsert(self, df: DataFrame, order: list[str], key: str = "id") -> None:
        """The latest row of each key replaces what the collection has."""
        fresh = self._fit(df)
        (upsert(self.read(), fresh, [key], order) if self.exists() else upsert(fresh.limit(0), fresh, [key], order)).write.parquet(f"{self.path}/g{self._current() + 1}")

    def delete(self, keys: DataFrame, key: str = "id") -> None:
        self.read().join(keys.select(key), key, "left_anti").write.parquet(f"{self.path}/g{self._current() + 1}")
