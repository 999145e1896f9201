"""A cache of vectors in a bucketed table, so that lookups don't shuffle it.

Rows (key, embedding, at) lie in `buckets` buckets by the hash of the key, sorted by key. A write is one shuffle of what is written,
and adds a file a bucket. A lookup deals the asked keys to the buckets and joins in place: neither the join nor the choice of the
latest row of a key moves a cached row. `compact` writes the latest rows anew when files have become many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "key STRING, embedding ARRAY<DOUBLE>, at TIMESTAMP"


class BucketedCache:
    """The cache `name` in a folder; generations of files stand in folders of their own, the table names the one in use."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 64):
        if buckets < 1:
            raise ValueError("buckets must be at least 1")
        self.spark, self.name, self.folder, self.buckets = spark, name, folder.rstrip("/"), buckets
        self._point(f"{self.folder}/base")

    def _point(self, at: str) -> None:
        """Lets the table name the files of a folder; its buckets stand in the names of the files."""
        self.at = at
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("key").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("at").cast("timestamp").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")

    def put(self, rows: DataFrame) -> None:
        """Adds rows (key, embedding, at); of the rows of a key the latest counts, of equally late ones the greatest vector. Rows without key or time are left out."""
        self._shaped(rows).repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(self.name)

    def latest(self, since: Column | str | None = None) -> DataFrame:
        """key, embedding and at of the latest row of each key; since: only rows that are as late."""
        self.spark.catalog.refreshTable(self.name)  # another session, such as a stream's, may have written
        rows = self.spark.table(self.name)
        rows = rows if since is None else rows.where(F.col("at") >= (F.lit(since).cast("timestamp") if isinstance(since, str) else since))
        return rows.groupBy("key").agg(F.max(F.struct("at", "embedding")).alias("r")).select("key", F.col("r.embedding").alias("embedding"), F.col("r.at").alias("at"))

    def lookup(self, keys: DataFrame, since: Column | str | None = None) -> DataFrame:
        """keys (key and more) with embedding, at and hit."""
        asked = keys.withColumn("key", F.col("key").cast("string"))
        # hinted, as a broadcast of either side would need its size checked
        found = asked.hint("merge").join(self.latest(since).hint("merge"), "key", "left")
        return found.withColumn("hit", F.col("at").isNotNull())

    def missing(self, keys: DataFrame, since: Column | str | None = None) -> DataFrame:
        """The distinct keys that a lookup doesn't find."""
        return self.lookup(keys.select("key").distinct(), since).where("NOT hit AND key IS NOT NULL").select("key")

    def compact(self, since: Column | str | None = None) -> None:
        """Keeps the latest row of each key, in one file a bucket, and drops what is older than since. The rows are written beside the old
        ones before the table names them; the old files are the caller's to remove, once no reader uses them."""
        last = self.latest(since).sortWithinPartitions("key")
        to = f"{self.folder}/g{self.spark.sql('SELECT uuid()').first()[0]}"
        fresh = f"{self.name}_fresh"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        self.spark.sql(f"CREATE TABLE {fresh} ({COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{to}'")
        last.repartition(self.buckets, "key").sortWithinPartitions("key").select("key", "embedding", "at").write.insertInto(fresh)
        self.spark.sql(f"DROP TABLE {fresh}")
        self._point(to)
