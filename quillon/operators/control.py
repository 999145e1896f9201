"""Adaptive batch sizes as analysis of recorded telemetry: the size that a rule advises after each recorded batch.

Every rule looks at the batch as it was recorded (its size, seconds and share of memory) and at windows over the batches before it in
its stream, so all rows of all streams are judged at once by window functions; nothing is simulated and no stream is
replayed row by row. The rules are CASE expressions in plain SQL, in columns of `recorded`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Targets and factors of the rules: fixed values.
LOW, HIGH, START = 1, 64, 8
GROWTH, SHRINK = "1.2e0", "0.7e0"

#: What the rules look at besides batch_size, processing_time and memory: by stream (`own`, in order), its last ten and five rows, the ten
#: before the last ten, and all rows before.
WINDOWS = {
    "n": "row_number() OVER ({own})",
    "now": "coalesce(batch_size / nullif(processing_time, 0), 0)",
    "mean10": "avg(coalesce(batch_size / nullif(processing_time, 0), 0)) OVER ({own} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "mean5": "avg(coalesce(batch_size / nullif(processing_time, 0), 0)) OVER ({own} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "earlier": "coalesce(sum(batch_size) OVER ({own} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) / nullif(sum(processing_time) OVER ({own} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING), 0), 0)",
}
#: Whether memory (seconds) went over its target after it was last well below: sticky limits.
LIMITS = {
    "memory_bound": "coalesce(max(CASE WHEN memory > 0.7e0 THEN n END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > coalesce(max(CASE WHEN memory < 0.7e0 * 0.7e0 THEN n END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
    "latency_bound": "coalesce(max(CASE WHEN processing_time > 2e0 THEN n END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > coalesce(max(CASE WHEN processing_time < 1e0 THEN n END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
}

RULES = {
    # memory, then seconds, then the trend of samples per second; else a little more
    "throughput": f"""CASE WHEN memory > 0.7e0 THEN batch_size * ({SHRINK} * (memory / 0.7e0))
  WHEN memory < 0.7e0 - 0.1e0 AND batch_size < {HIGH} AND processing_time < 2e0 THEN batch_size * least({GROWTH} * (1 + (0.7e0 - memory)), 2e0)
  WHEN processing_time > 2e0 THEN batch_size * {SHRINK} / (processing_time / 2e0)
  WHEN processing_time < 2e0 * 0.7e0 THEN batch_size * {GROWTH}
  WHEN n < 2 THEN batch_size WHEN mean10 > earlier THEN batch_size * {GROWTH} WHEN mean10 < earlier * 0.95e0 THEN batch_size * {SHRINK} ELSE batch_size * 1.05e0 END""",
    # limits that were met stick; free of them one up or down as a batch leaves the mean of five by a tenth
    "steady": """CASE WHEN memory > 0.7e0 THEN batch_size * (0.8e0 / greatest(1e0, memory / 0.7e0))
  WHEN memory < 0.7e0 - 0.1e0 AND memory_bound THEN batch_size * least(1.2e0, 1 + (0.7e0 - memory))
  WHEN processing_time > 2e0 THEN batch_size * (0.9e0 / greatest(1e0, processing_time / 2e0))
  WHEN processing_time < 2e0 * 0.7e0 AND latency_bound THEN batch_size * least(1.2e0, 1 + (1 - processing_time / 2e0) * 0.5e0)
  WHEN n <= 2 THEN batch_size WHEN now > mean5 * 1.1e0 THEN batch_size + 1 WHEN now < mean5 * 0.9e0 THEN batch_size - 1 ELSE batch_size END""",
    # nothing for two batches; then a fifth up while there is room (two up if the projected memory is too much), a fifth down if not
    "warm_up": f"""CASE WHEN n < 3 THEN batch_size
  WHEN memory < 0.7e0 * 0.8e0 AND processing_time < 0.5e0 THEN
    CASE WHEN memory * (least(floor(batch_size * {GROWTH}), {HIGH}) / batch_size) > 0.7e0 THEN batch_size + 2 ELSE batch_size * {GROWTH} END
  WHEN memory > 0.7e0 OR processing_time > 2e0 THEN batch_size * 0.8e0 ELSE batch_size END""",
    "one_step": "CASE WHEN memory > 0.8e0 THEN batch_size - 1 WHEN memory < 0.5e0 AND processing_time / batch_size < 0.5e0 THEN batch_size + 1 ELSE batch_size END",
    # more than ten seconds after the batch before: two up below 0.01 s a sample, two down above 0.1, not below the start
    "per_sample": f"""CASE WHEN pause <= 10 THEN batch_size WHEN processing_time / batch_size < 0.01e0 THEN batch_size + 2
  WHEN processing_time / batch_size > 0.1e0 AND batch_size > {START} THEN greatest({START}, batch_size - 2) ELSE batch_size END""",
    # five seconds or more after the batch before: the smaller gap to both targets, halved, at most half of the size, within free memory
    "gap": """CASE WHEN pause < 5 THEN batch_size ELSE
  least(floor(batch_size * (1 + greatest(-0.5e0, least(0.5e0, least((80e0 - cpu) / 100, (80e0 - memory * 100) / 100) * 0.5e0)))), floor(room * 0.7e0)) END""",
}


def recorded(telemetry: DataFrame, by: str) -> DataFrame:
    """telemetry (by, ts, event_id, batch_size, processing_time, memory) with what the rules look at; pause: seconds since the batch
    before (a day at the first). cpu (percent) and room (samples that free memory holds), for `gap`, come with the telemetry."""
    own = f"PARTITION BY {by} ORDER BY ts, event_id"
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    before = F.lag(seconds).over(Window.partitionBy(by).orderBy("ts", "event_id"))
    out = telemetry.withColumn("pause", F.coalesce(seconds - before, F.lit(86400.0)))
    for group in (WINDOWS, LIMITS):
        out = out.withColumns({c: F.expr(e.format(own=own)) for c, e in group.items()})
    return out


def clamped(size: str) -> str:
    return f"CAST(greatest({LOW}, least({HIGH}, floor({size}))) AS INT)"


def advised(telemetry: DataFrame, by: str, rule: str) -> DataFrame:
    """by, event_id and advice, the size that the rule advises after each batch, within LOW and HIGH."""
    return recorded(telemetry, by).select(by, "event_id", F.expr(clamped(RULES[rule])).alias("advice"))


def best_mean(telemetry: DataFrame, by: str, least: int = 5) -> DataFrame:
    """by and advice: the size of the highest mean samples per second of each stream (ties: the smaller); with fewer than `least`
    batches the largest seen. One aggregation by stream and size, one by stream."""
    rate = F.coalesce(F.try_divide(F.col("batch_size").cast("double"), F.col("processing_time")), F.lit(0.0))
    sizes = telemetry.groupBy(by, "batch_size").agg(F.avg(rate).alias("mean"), F.count("*").alias("n"))
    best = F.max_by("batch_size", F.struct("mean", -F.col("batch_size")))
    advice = F.when(F.sum("n") < least, F.max("batch_size")).otherwise(best)
    return sizes.groupBy(by).agg(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), advice)).cast("int").alias("advice"))
