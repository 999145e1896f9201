"""Two tables met block by block: every block of one with every block of the other, each pair in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of the vectors of one block, at most; a row that is larger is a block of its own.
BYTES = 1 << 26


def _sized(df: DataFrame, most: int) -> tuple[int, int]:
    """The rows of df, and how many of them make a block: `most`, or as many as keep its vectors within BYTES."""
    vectors = [c for c, t in df.dtypes if t in ("array<double>", "array<float>")]
    n, *wide = df.agg(F.count("*"), *[F.max(F.size(c)) for c in vectors]).first()
    width = 8 * sum(w or 0 for w in wide)
    return n, min(most, max(1, BYTES // width)) if width else most


def met(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, left_rows: int = 4096, right_rows: int = 1 << 16, key: str = "id", few_vectors: bool = False) -> DataFrame:
    """The rows that work makes of each pair of blocks. The hash of the key deals rows into blocks of about left_rows and
    right_rows (fewer where their vectors are wide, more blocks on the right while there are cores without one), so that what a task holds is
    bounded, neither side passes the driver and no pair of rows leaves a task but through work. few_vectors: most rows of the left hold none, so left_rows stands."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    (few, left_rows), (many, right_rows) = (left.count(), left_rows) if few_vectors else _sized(left, left_rows), _sized(right, right_rows)
    lefts, rights = max(1, -(-few // left_rows)), max(1, -(-many // right_rows), min(cores, many // 512))
    spot = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("*", spot(lefts).alias("_l"), every(rights).alias("_r"))
    b = right.select("*", every(lefts).alias("_l"), spot(rights).alias("_r"))
    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInArrow(work, schema)


def crossed(left: DataFrame, right: DataFrame, work: Callable[[pa.RecordBatch, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, left_rows: int = 64, right_rows: int = 256, key: str = "id") -> DataFrame:
    """The rows that work makes of each pair of blocks, for work with a row per pair of rows. Unlike met, which sends a row out once for each block it
    meets, both sides are shuffled once, whatever the number of blocks, and partitions of 8 left and 16 right blocks meet in tasks that read them again."""
    cores = left.sparkSession.sparkContext.defaultParallelism

    def packed(df: DataFrame, most: int, each: int, spread: int, name: str) -> DataFrame:
        n, rows = _sized(df, most)
        blocks = max(1, -(-n // rows))
        parts = max(-(-blocks // each), min(spread, blocks))
        own = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.struct(*df.columns).alias("x"))
        return own.repartition(parts, "block").groupBy("block").agg(F.collect_list("x").alias(name)).select(name)  # the rows of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from work(*(pa.RecordBatch.from_struct_array(b.column(c)[k].values) for c in ("l", "r")))

    pairs = packed(left, left_rows, 8, 1, "l").hint("shuffle_replicate_nl").crossJoin(packed(right, right_rows, 16, 2 * cores, "r"))
    return pairs.mapInArrow(run, schema)


def swept(items: DataFrame, queries: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, many: int, whole: bool = False) -> DataFrame:
    """The rows that work makes of a stream of pairs of a packed block of items and one of the `many` packed blocks of queries (both stored, a row a block; q_block: its number).
    A task holds its blocks of queries while the items' files stream past them, so nothing is shuffled but the queries, once, and work may keep what it
    likes to keep of the items so far. whole: every task meets all items; otherwise few queries have the items dealt into shares, so that all cores have a task."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    shares = 1 if whole else max(1, -(-2 * cores // many))
    return items.coalesce(shares).hint("shuffle_replicate_nl").crossJoin(queries.repartitionByRange(many, "q_block")).mapInArrow(work, schema)


def met_by(on: str, left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, left_rows: int = 1024, right_rows: int = 1 << 14, key: str = "id") -> DataFrame:
    """met within each value of `on`: the rows that work makes of each pair of blocks of equal `on`. A value that holds more rows
    than a block on either side is split into as many as it needs, so a hot value is no task of its own. Values that
    one side lacks make nothing. `on` must have a bounded number of values (cells, buckets), as their counts are sent to every task."""
    counts = left.groupBy(on).agg(F.count("*").alias("_nl")).join(right.groupBy(on).agg(F.count("*").alias("_nr")), on)
    parts = F.broadcast(counts.select(on, F.ceil(F.col("_nl") / left_rows).cast("int").alias("_nl"), F.ceil(F.col("_nr") / right_rows).cast("int").alias("_nr")))
    spot = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(parts, on).select(*left.columns, spot("_nl").alias("_l"), every("_nr").alias("_r"))
    b = right.join(parts, on).select(*right.columns, every("_nl").alias("_l"), spot("_nr").alias("_r"))
    return a.groupBy(on, "_l", "_r").cogroup(b.groupBy(on, "_l", "_r")).applyInArrow(work, schema)
