"""Batch telemetry over the events table: a user is a stream, value / 1000 its seconds, props.k its batch size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control
from ..operators import telemetry as op
from ..sources.readers import table
from .registry import Registry

plans = Registry()
BY = ["user_id"]


def batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    size = (F.get_json_object("props", "$.k").cast("int") % 64 + 1).alias("batch_size")
    return rows.select("event_id", "user_id", "event_type", "ts", "value", size, (F.col("value") / 1000).alias("processing_time"))


_T = "WITH t AS (SELECT event_id, user_id, event_type, ts, value, CAST(props->>'$.k' AS INTEGER) % 64 + 1 AS batch_size, value / 1000 AS processing_time FROM events)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id"


def _r(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@plans.query(_T + f" SELECT event_id, round(avg(batch_size) OVER {_W} ROWS 9 PRECEDING), 8) AS avg_batch, round(avg(processing_time) OVER {_W} ROWS 9 PRECEDING), 8) AS avg_time, round(coalesce(sum(batch_size) OVER {_W} ROWS 9 PRECEDING) / nullif(sum(processing_time) OVER {_W} ROWS 9 PRECEDING), 0), 0), 3) AS throughput FROM t")
def moving_averages(spark: SparkSession, sf: str) -> DataFrame:
    found = op.moving_averages(batches(spark, sf), BY, 10).select("event_id", "avg_batch", "avg_time", "throughput")
    return found.select("event_id", F.round("avg_batch", 8).alias("avg_batch"), F.round("avg_time", 8).alias("avg_time"), F.round("throughput", 3).alias("throughput"))


@plans.query(_T + " SELECT event_id, user_id FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    return op.bounded(batches(spark, sf), BY, 5).select("event_id", "user_id")


@plans.query(_T + f", l AS (SELECT *, lag(batch_size) OVER {_W}) AS b FROM t) SELECT event_id, round(coalesce((batch_size - b) / nullif(CAST(b AS DOUBLE), 0), 0), 5) AS change FROM l")
def relative_change(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.change(batches(spark, sf), BY, "batch_size").select("event_id", "change"))


@plans.query(_T + f" SELECT event_id FROM t QUALIFY row_number() OVER {_W}) % 10 = 0")
def every_tenth(spark: SparkSession, sf: str) -> DataFrame:
    return op.every(batches(spark, sf), BY, 10).select("event_id")


@plans.query(_T + f" SELECT event_id, count(*) OVER {_W}) AS n, round(sum(value) OVER {_W}), 3) AS total, max(value) OVER {_W}) AS best, round((epoch_us(ts) - epoch_us(first(ts) OVER {_W}))) / 1e6, 3) AS elapsed FROM t")
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    found = op.running(batches(spark, sf), BY, "value")
    return found.select("event_id", "n", F.round("total", 3).alias("total"), "best", F.round("elapsed", 3).alias("elapsed"))


@plans.query(_T + f" SELECT event_id, CAST(floor((row_number() OVER {_W}) - 1) / 8) AS BIGINT) AS batch FROM t")
def batch_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.batches(batches(spark, sf), BY, 8).select("event_id", "batch")


@plans.query(
    _T
    + f""", d AS (SELECT *, CAST(sign(batch_size - lag(batch_size) OVER {_W})) AS INTEGER) AS direction FROM t),
n AS (SELECT *, CAST(direction IS DISTINCT FROM lag(direction) OVER {_W}) AS INTEGER) AS fresh FROM d), r AS (SELECT *, CAST(sum(fresh) OVER {_W}) AS BIGINT) AS run FROM n)
SELECT event_id, direction, run, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INTEGER) AS streak FROM r"""
)
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return op.runs(batches(spark, sf), BY, "batch_size").select("event_id", "direction", "run", "streak")


@plans.query(_T + " SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(coalesce(arg_max(value, ts) / nullif(arg_min(value, ts), 0), 0), 5) AS improvement FROM t GROUP BY user_id")
def improvement(spark: SparkSession, sf: str) -> DataFrame:
    return op.improvement(batches(spark, sf), BY, "value").withColumn("improvement", F.round("improvement", 5))


@plans.query(_T + f" SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN batch_size END IGNORE NULLS) OVER {_W}) AS current FROM t")
def carried_size(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches(spark, sf).withColumn("adjusted", F.when(F.col("event_type") == "purchase", F.col("batch_size")))
    return op.carried(rows, BY, "adjusted").select("event_id", "current")


@plans.query(_T + f", b AS (SELECT *, CAST(floor((row_number() OVER {_W}) - 1) / 10) AS BIGINT) AS batch FROM t) SELECT user_id, batch, count(*) AS ops, round(coalesce(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 0), 5) AS ops_per_s FROM b GROUP BY user_id, batch")
def sampled_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.sampled_rate(batches(spark, sf), BY, 10))


@plans.query(_T + ", m AS (SELECT batch_size, avg(coalesce(batch_size / nullif(processing_time, 0), 0)) AS m FROM t GROUP BY 1) SELECT CAST(arg_max(batch_size, m) AS INTEGER) AS batch_size FROM m")
def best_batch_size(spark: SparkSession, sf: str) -> DataFrame:
    return op.best_batch_size(batches(spark, sf))


_SUM = """count(*) AS batches, CAST(coalesce(sum(batch_size), 0) AS BIGINT) AS samples, round(coalesce(sum(processing_time), 0), 4) AS seconds, round(coalesce(avg(batch_size), 0), 5) AS avg_batch, round(coalesce(avg(processing_time), 0), 5) AS avg_time,
round(coalesce(quantile_cont(processing_time, 0.95), 0), 5) AS p95, round(coalesce(sum(batch_size) / nullif(sum(processing_time), 0), 0), 4) AS throughput, round(coalesce(avg(coalesce(batch_size / nullif(processing_time, 0), 0)), 0), 3) AS mean_throughput"""


def _sum(df: DataFrame) -> DataFrame:
    digits = {"seconds": 4, "throughput": 4, "mean_throughput": 3}
    return df.select(*[F.round(c, digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@plans.query(_T + f" SELECT event_type, {_SUM} FROM t GROUP BY event_type")
def telemetry_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _sum(op.summary(batches(spark, sf), "event_type"))


@plans.query(_T + f" SELECT {_SUM} FROM t WHERE value < 0")
def telemetry_summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing measured: zeros."""
    return _sum(op.summary(batches(spark, sf).where("value < 0")))


@plans.query(_T + " SELECT event_type, round(avg(processing_time) * 1000, 4) AS mean_ms, round(quantile_cont(processing_time, 0.95) * 1000, 4) AS p95_ms, round(quantile_cont(processing_time, 0.99) * 1000, 4) AS p99_ms FROM t GROUP BY event_type")
def latency(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.latency(batches(spark, sf), "processing_time", "event_type"), 4)


@plans.query(_T + " SELECT event_type, round(regr_slope(value, batch_size), 4) AS slope, round(regr_intercept(value, batch_size), 4) AS intercept FROM t GROUP BY event_type")
def trend(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.trend(batches(spark, sf), "value", "batch_size", "event_type"), 4)


@plans.query(_T + " SELECT batch_size, round(avg(value), 5) AS avg_value, round(avg(processing_time), 5) AS avg_processing_time FROM t GROUP BY batch_size")
def means_by_batch_size(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.means(batches(spark, sf).select("batch_size", "value", "processing_time"), "batch_size"))


@plans.query(_T + ", a AS (SELECT batch_size, avg(value) AS m FROM t WHERE event_type = 'click' GROUP BY 1), b AS (SELECT batch_size, avg(value) AS m FROM t WHERE event_type = 'view' GROUP BY 1) SELECT a.batch_size, round(a.m, 5) AS baseline, round(b.m, 5) AS other, round(100 * (b.m - a.m) / nullif(a.m, 0), 4) AS percent FROM a LEFT JOIN b USING (batch_size)")
def baseline_compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches(spark, sf)
    side = lambda kind: rows.where(F.col("event_type") == kind).groupBy("batch_size").agg(F.avg("value").alias("m"))
    found = op.compared(side("click"), side("view"), ["batch_size"], "m")
    return found.select("batch_size", F.round("baseline", 5).alias("baseline"), F.round("other", 5).alias("other"), F.round("percent", 4).alias("percent"))


@plans.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.tumbling(table(spark, sf, "events"), "1 hour", "event_type"), 3)


@plans.query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start, count(*) AS n, round(sum(value), 3) AS total FROM events, range(2) AS t(s) GROUP BY ALL")
def sliding_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _r(op.sliding(table(spark, sf, "events"), "1 hour", "30 minutes"), 3)


@plans.query("WITH g AS (SELECT *, CAST(coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS INTEGER) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return op.sessions(table(spark, sf, "events"), "30 minutes", "user_id")


@plans.query("SELECT event_type, round(avg(CAST(value > 5 AS DOUBLE)), 6) AS success_rate FROM events GROUP BY event_type")
def success_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "events").groupBy("event_type").agg(*[r.alias("success_rate") for r in op.rates(table(spark, sf, "events"), [(F.col("value") > 5).cast("int")], F.lit(1))])
    return _r(found, 6)


# Sizes that the rules advise after recorded batches; size / 64 stands for the share of memory, seconds for the load. The SQL is written apart
# from the rules: it looks at the whole history of a stream as lists, with all targets and factors as plain numbers.
_HISTORY = """
WITH b AS (SELECT event_id, user_id, ts, CAST(props->>'$.k' AS INTEGER) % 64 + 1 AS size, value / 1000 AS sec FROM events),
h AS (SELECT user_id, event_id, size, sec, size / 64e0 AS mem, row_number() OVER w AS n, list(size) OVER w AS sizes, list(sec) OVER w AS secs, list(epoch_us(ts)) OVER w AS times
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN secs[i] = 0 THEN 0 ELSE sizes[i] / secs[i] END) AS rates,
  CASE WHEN n = 1 THEN 86400 ELSE (times[n] - times[n - 1]) / 1e6 END AS pause,
  CASE WHEN n <= 10 OR list_sum(secs[greatest(1, n - 19):n - 10]) = 0 THEN 0 ELSE list_sum(sizes[greatest(1, n - 19):n - 10]) / list_sum(secs[greatest(1, n - 19):n - 10]) END AS earlier,
  coalesce(sizes[list_max(list_filter(range(1, n), lambda i: sizes[i] > 44.8 OR sizes[i] < 31.36))] > 44.8, false) AS full_once,
  coalesce(secs[list_max(list_filter(range(1, n), lambda i: secs[i] > 2 OR secs[i] < 1))] > 2, false) AS slow_once FROM h),
a AS (SELECT *, list_avg(rates[-10:]) AS mean10, list_avg(rates[-5:]) AS mean5, rates[n] AS rate FROM r)
SELECT user_id, event_id, CAST(greatest(1, least(64, floor({size}))) AS INTEGER) AS advice FROM a"""
_SIZES = {
    "throughput": """CASE WHEN mem > 0.7 THEN size * (0.7e0 * (mem / 0.7e0)) WHEN mem < 0.7e0 - 0.1e0 AND size < 64 AND sec < 2 THEN size * least(1.2e0 * (1 + (0.7e0 - mem)), 2)
      WHEN sec > 2 THEN size * 0.7e0 / (sec / 2) WHEN sec < 1.4 THEN size * 1.2e0 WHEN n = 1 THEN size WHEN mean10 > earlier THEN size * 1.2e0 WHEN mean10 < 0.95e0 * earlier THEN size * 0.7e0 ELSE size * 1.05e0 END""",
    "steady": """CASE WHEN mem > 0.7 THEN size * (0.8e0 / (mem / 0.7e0)) WHEN mem < 0.7e0 - 0.1e0 AND full_once THEN size * least(1.2e0, 1.7e0 - mem)
      WHEN sec > 2 THEN size * (0.9e0 / (sec / 2)) WHEN sec < 1.4 AND slow_once THEN size * least(1.2e0, 1.5e0 - sec / 4)
      WHEN n < 3 THEN size WHEN rate > 1.1e0 * mean5 THEN size + 1 WHEN rate < 0.9e0 * mean5 THEN size - 1 ELSE size END""",
    "warm_up": """CASE WHEN n <= 2 THEN size WHEN size < 35.84 AND sec < 0.5 THEN CASE WHEN least(floor(1.2e0 * size), 64) > 44.8 THEN size + 2 ELSE 1.2e0 * size END
      WHEN size > 44.8 OR sec > 2 THEN 0.8e0 * size ELSE size END""",
    "one_step": "size + CASE WHEN size > 51.2 THEN -1 WHEN size < 32 AND sec < 0.5e0 * size THEN 1 ELSE 0 END",
    "per_sample": "CASE WHEN pause <= 10 THEN size WHEN sec / size < 0.01e0 THEN size + 2 WHEN sec / size > 0.1e0 AND size > 8 THEN greatest(8, size - 2) ELSE size END",
    "gap": "CASE WHEN pause < 5 THEN size ELSE least(floor(size * (1 + greatest(-0.5e0, least(0.5e0, least((80e0 - least(1, sec) * 100) / 100, (80e0 - mem * 100) / 100) * 0.5e0)))), floor((65 - size) * 0.7e0)) END",
}


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("batch_size")
    return batches(spark, sf).withColumns({"memory": size / 64.0, "cpu": F.least(F.lit(1.0), F.col("processing_time")) * 100, "room": 65 - size})


def _advised(rule: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return control.advised(_recorded(spark, sf), "user_id", rule)

    return run


for _rule in control.RULES:
    plans.query(_HISTORY.replace("{size}", _SIZES[_rule]), f"batch_size_{_rule}")(_advised(_rule))


@plans.query(
    _T
    + """, m AS (SELECT user_id, batch_size, avg(coalesce(batch_size / nullif(processing_time, 0), 0)) AS mean, count(*) AS n FROM t GROUP BY ALL)
SELECT user_id, CAST(CASE WHEN sum(n) < 5 THEN max(batch_size) ELSE arg_max(batch_size, (mean, -batch_size)) END AS INTEGER) AS advice FROM m GROUP BY user_id""",
    "batch_size_best_mean",
)
def batch_size_best_mean(spark: SparkSession, sf: str) -> DataFrame:
    return control.best_mean(batches(spark, sf), "user_id")
