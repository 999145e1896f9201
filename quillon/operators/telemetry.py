"""Batch telemetry: windows over the last batches, summaries, trends.

A telemetry row has ts, an id, batch_size, processing_time (seconds) and, where known, memory. Windows run within a
stream (`by`), so each stream is ordered on its own; a table without streams must name a coarse key (a day, a device).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rules import ratio

ORDER = ["ts", "event_id"]


def in_order(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*ORDER)


def last(by: list[str], n: int) -> WindowSpec:
    return in_order(by).rowsBetween(-(n - 1), 0)


def moving_averages(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The mean of batch size and time, and samples per second, over the last n batches."""
    own = last(by, n)
    return df.withColumns({"avg_batch": F.avg("batch_size").over(own), "avg_time": F.avg("processing_time").over(own), "throughput": ratio(F.sum("batch_size").over(own), F.sum("processing_time").over(own))})


def bounded(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The last n rows of each stream."""
    order = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in ORDER])
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def change(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Relative change of a value against the row before; 0 at the first row and after a 0."""
    before = F.lag(value).over(in_order(by))
    return df.withColumn("change", ratio(F.col(value) - before, before))


def every(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Each k-th row."""
    return df.withColumn("_n", F.row_number().over(in_order(by))).where(F.col("_n") % k == 0).drop("_n")


def running(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Running count, sum, best so far and elapsed seconds since the first row."""
    own = in_order(by).rowsBetween(Window.unboundedPreceding, 0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))  # whole numbers until after the difference
    return df.withColumns({"n": F.count("*").over(own), "total": F.sum(value).over(own), "best": F.max(value).over(own), "elapsed": (at - F.first(at).over(own)) / 1e6})


def batches(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """batch: the number of the batch of `size` rows that a row falls into."""
    return df.withColumn("batch", F.floor((F.row_number().over(in_order(by)) - 1) / size))


def runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """run: consecutive rows that rise (or fall, or stay) share a number; streak: the place in it."""
    own = in_order(by)
    df = df.withColumn("direction", F.signum(F.col(value) - F.lag(value).over(own)).cast("int"))
    df = df.withColumn("_new", (~F.col("direction").eqNullSafe(F.lag("direction").over(own))).cast("int"))
    df = df.withColumn("run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return df.withColumn("streak", F.row_number().over(Window.partitionBy(*by, "run").orderBy(*ORDER)))


def reset_runs(df: DataFrame, by: list[str], value: str, most: int = 3) -> DataFrame:
    """counter: consecutive rises or falls, starting anew after `most`; fires: whether it is there. Rows that neither rise nor fall: 0."""
    df = runs(df, by, value)
    moved = F.coalesce(F.col("direction") != 0, F.lit(False))
    df = df.withColumn("counter", F.when(moved, (F.col("streak") - 1) % most + 1).otherwise(0))
    return df.withColumn("fires", F.col("counter") == most)


def best_so_far(df: DataFrame, by: list[str], value: str, of: str) -> DataFrame:
    """best and best_at: the greatest value up to each row, and `of` of its (first) row."""
    so_far, before = (in_order(by).rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    fresh = F.coalesce(F.col(value) > F.max(value).over(before), F.col(value).isNotNull())
    df = df.withColumn("best", F.max(value).over(so_far)).withColumn("_at", F.when(fresh, F.col(of)))
    return df.withColumn("best_at", F.last("_at", ignorenulls=True).over(so_far)).drop("_at")


def per_sample(df: DataFrame, amount: str, samples: str, *by: str) -> DataFrame:
    """Mean of an amount (memory, seconds) over the rows that have one, and its sum per sample (0 without samples)."""
    return df.groupBy(*by).agg(F.avg(amount).alias("mean"), ratio(F.sum(amount), F.sum(F.when(F.col(amount).isNotNull(), F.col(samples)))).alias("per_sample"))


def improvement(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """First and last value of each stream and the last over the first."""
    first, final = F.min_by(value, F.struct(*ORDER)), F.max_by(value, F.struct(*ORDER))
    return df.groupBy(*by).agg(first.alias("first"), final.alias("last")).withColumn("improvement", ratio(F.col("last"), F.col("first")))


def carried(df: DataFrame, by: list[str], adjusted: str) -> DataFrame:
    """current: the latest adjusted value at each row, carried forward over rows without one."""
    return df.withColumn("current", F.last(adjusted, ignorenulls=True).over(in_order(by).rowsBetween(Window.unboundedPreceding, 0)))


def sampled_rate(df: DataFrame, by: list[str], n: int = 100) -> DataFrame:
    """Operations per second of each stretch of n rows."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return batches(df, by, n).groupBy(*by, "batch").agg(F.count("*").alias("ops"), ratio(F.count("*"), (F.max(at) - F.min(at)) / 1e6).alias("ops_per_s"))


def best_batch_size(df: DataFrame, least: int = 5) -> DataFrame:
    """The batch size of the highest mean throughput; the largest seen with fewer than `least` rows; 16 without any."""
    by = df.groupBy("batch_size").agg(F.avg(ratio(F.col("batch_size"), F.col("processing_time"))).alias("mean"), F.count("*").alias("n"))
    best = by.agg(F.sum("n").alias("n"), F.max_by("batch_size", F.struct("mean", -F.col("batch_size"))).alias("best"), F.max("batch_size").alias("largest"))
    return best.select(F.when(F.coalesce("n", F.lit(0)) == 0, 16).when(F.col("n") < least, F.col("largest")).otherwise(F.col("best")).cast("int").alias("batch_size"))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Batches, samples, seconds, mean sizes and times (0 when empty); throughput as the ratio of sums and as the mean of ratios."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("batches"),
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("samples"),
        zero(F.sum("processing_time")).alias("seconds"),
        zero(F.avg("batch_size").cast("double")).alias("avg_batch"),
        zero(F.avg("processing_time")).alias("avg_time"),
        zero(F.percentile("processing_time", 0.95)).alias("p95"),
        ratio(F.sum("batch_size"), F.sum("processing_time")).alias("throughput"),
        zero(F.avg(ratio(F.col("batch_size"), F.col("processing_time")))).alias("mean_throughput"),
    )


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, p95 and p99 in milliseconds (of seconds)."""
    return df.groupBy(*by).agg((F.avg(value) * 1000).alias("mean_ms"), (F.percentile(value, 0.95) * 1000).alias("p95_ms"), (F.percentile(value, 0.99) * 1000).alias("p99_ms"))


def trend(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """Slope and intercept of a straight line."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def means(df: DataFrame, *by: str) -> DataFrame:
    """The mean of every numeric column."""
    numeric = [c for c, t in df.dtypes if c not in by and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return df.groupBy(*by).agg(*[F.avg(c).cast("double").alias(f"avg_{c}") for c in numeric])


def compared(baseline: DataFrame, other: DataFrame, on: list[str], value: str) -> DataFrame:
    """Baseline and other side by side, with the change in percent; sides may lack a key."""
    both = baseline.select(*on, F.col(value).alias("baseline")).join(other.select(*on, F.col(value).alias("other")), on, "left")
    return both.withColumn("percent", ratio(100 * (F.col("other") - F.col("baseline")), F.col("baseline"), None))


def rates(df: DataFrame, parts: list[Column], whole: Column) -> list[Column]:
    """Each part over the whole (instruction mixes, success rates)."""
    return [ratio(F.sum(p), F.sum(whole)) for p in parts]


def tumbling(df: DataFrame, width: str, *by: str) -> DataFrame:
    return df.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, width: str, step: str, *by: str) -> DataFrame:
    return df.groupBy(F.window("ts", width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, *by: str) -> DataFrame:
    return df.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
