"""Requests, plans, transcripts and keyed status over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, encoders
from ..sources.readers import table
from .registry import Registry

plans = Registry()


@plans.query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'AI: ' END || replace(coalesce(text, ''), chr(10), '') || ' | ', '' ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return agents.transcript(table(spark, sf, "conversations"))


@plans.query("SELECT conv_id, 'System' || chr(10) || string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def history_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return agents.prompt(table(spark, sf, "conversations"), "System")


@plans.query("SELECT conv_id, list(text ORDER BY turn DESC, text DESC) AS items FROM conversations GROUP BY conv_id")
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return agents.newest_first(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@plans.query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return agents.latest_status(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@plans.query("SELECT event_id, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'agent' ELSE 'ignored' END AS branch FROM events")
def routed_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", agents.routed("event_type", {"click": "user", "view": "agent"}).alias("branch"))


_TASKS = """
WITH q AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'all tasks' ELSE 'Browsing, ' || n_name END AS request FROM nation),
t AS (SELECT id, CASE WHEN request = 'all tasks' THEN ['browsing', 'contact_search', 'calendar_management', 'email_management', 'phone_calls', 'task_planning'] ELSE list_transform(string_split(request, ','), lambda x: replace(lower(trim(x)), ' ', '_')) END AS tasks FROM q),
p AS (SELECT id, CAST(k - 1 AS INTEGER) AS place, tasks[k] AS task FROM t, unnest(range(1, len(tasks) + 1)) AS r(k))
"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    request = F.when(F.col("n_nationkey") % 5 == 0, "all tasks").otherwise(F.concat(F.lit("Browsing, "), "n_name"))
    return agents.parsed(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), request.alias("request")), "id", "request")


@plans.query(_TASKS + "SELECT id, place, task FROM p")
def parsed_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf)


_PLANNED = (
    _TASKS
    + ", known(task, title, said, on_day) AS (VALUES "
    + ", ".join(str(d) for d in agents.DEFINITIONS)
    + """), j AS (SELECT id, place, p.task, coalesce(title, array_to_string(list_transform(string_split(p.task, '_'), lambda w: upper(w[1]) || w[2:]), '_')) AS title, coalesce(said, 'N/A') AS said, coalesce(on_day, 'N/A') AS on_day FROM p LEFT JOIN known ON known.task = p.task) """
)


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return agents.planned(_tasks(spark, sf), agents.definitions(spark))


@plans.query(_PLANNED + "SELECT id, place, task, title, said AS last_commit_message, on_day AS last_commit_date FROM j")
def plans_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with their definitions, or defaults."""
    return _plan(spark, sf).select("id", "place", "task", "title", "last_commit_message", "last_commit_date")


@plans.query(_PLANNED + "SELECT id, place, '[' || title || '] Executed with commit message ' || chr(39) || said || chr(39) || ' (Committed: ' || on_day || ').' AS result FROM j")
def executed_plans(spark: SparkSession, sf: str) -> DataFrame:
    return agents.executed(_plan(spark, sf)).select("id", "place", "result")


@plans.query(_TASKS + ", e AS (SELECT id, place, '- ' || task AS line FROM p) SELECT id, string_agg(line, chr(10) ORDER BY place) AS report FROM e GROUP BY id")
def reports(spark: SparkSession, sf: str) -> DataFrame:
    return agents.report(_tasks(spark, sf).withColumnRenamed("task", "result"), "id")


@plans.query(
    """WITH w AS (SELECT item_id, md5(w) AS h FROM (SELECT item_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> ''),
b AS (SELECT item_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 64 AS place, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w),
s AS (SELECT i.item_id, p.place, coalesce(sum(b.sign), 0) AS x FROM (SELECT DISTINCT item_id FROM benchmark) i CROSS JOIN (SELECT unnest(range(64)) AS place) p LEFT JOIN b ON b.item_id = i.item_id AND b.place = p.place GROUP BY i.item_id, p.place),
v AS (SELECT item_id, list(CAST(x AS DOUBLE) ORDER BY place) AS v FROM s GROUP BY item_id)
SELECT item_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) + 0.0) AS embedding FROM v"""
)
def encoded_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the benchmark texts by the stand-in encoder."""
    found = encoders.encode(table(spark, sf, "benchmark"), "item_id", "text")
    return found.select("item_id", F.transform("embedding", lambda x: F.round(x, 6) + 0.0).alias("embedding"))
