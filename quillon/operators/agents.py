"""Requests, plans, transcripts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The known tasks: task, title, last commit message, last commit date. Fixed values.
DEFINITIONS = [
    ("browsing", "Browsing", "initialize project with turborepo", "2 days ago"),
    ("calendar", "Calendar", "initialize project with turborepo", "2 days ago"),
    ("call", "Call", "add onto main", "2 days ago"),
    ("contact_search", "Contact Search", "initialize project with turborepo", "2 days ago"),
    ("email", "Email", "initialize project with turborepo", "2 days ago"),
    ("search", "Search", "initialize project with turborepo", "2 days ago"),
    ("keyboard", "Keyboard Input", "simulate keyboard input", "today"),
    ("mouse", "Mouse Control", "simulate mouse click", "today"),
    ("vision", "Screen Capture", "capture screenshot", "today"),
    ("webbrowse", "Web Browser Control", "simulate browser action", "today"),
]


def parsed(requests: DataFrame, key: str, request: str) -> DataFrame:
    """A row per task of a request: key, place (from 0) and task."""
    return requests.select(key, F.posexplode(T.tasks(request)).alias("place", "task"))


def definitions(spark: SparkSession) -> DataFrame:
    """The known tasks as a table."""
    return spark.createDataFrame(DEFINITIONS, "task string, title string, last_commit_message string, last_commit_date string")


def planned(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """Tasks with title, last_commit_message and last_commit_date of their definition (task, ...); an unknown task has its
    name in capitals as title, and N/A."""
    joined = tasks.join(known, "task", "left")
    blank = {"title": T.title("task"), "last_commit_message": F.lit("N/A"), "last_commit_date": F.lit("N/A")}
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in blank.items()})


def executed(plan: DataFrame) -> DataFrame:
    """result of each task of a plan; missing details have defaults."""
    title, said, on = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("title", "Unknown Task"), ("last_commit_message", "N/A"), ("last_commit_date", "N/A")))
    return plan.withColumn("result", F.format_string("[%s] Executed with commit message '%s' (Committed: %s).", title, said, on))


def report(results: DataFrame, key: str) -> DataFrame:
    """One report per request, its results in order."""
    return results.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "result"))), lambda x: F.concat(F.lit("- "), x["result"])), "\n").alias("report"))


def transcript(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", human: str = "user") -> DataFrame:
    """One line per conversation: "User: ... | AI: ... | ", newlines dropped."""
    said = F.struct(F.col(order).alias("o"), F.col(role).alias("r"), T.one_line(F.coalesce(text, F.lit(""))).alias("t"))
    parts = F.transform(F.sort_array(F.collect_list(said)), lambda x: F.concat(F.when(x["r"] == human, "User: ").otherwise("AI: "), x["t"], F.lit(" | ")))
    return turns.groupBy(key).agg(F.array_join(parts, "").alias("transcript"))


def prompt(turns: DataFrame, system: str, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prompt that a conversation's history makes."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t")))), lambda x: F.concat_ws(": ", x["r"], x["t"]))
    return turns.groupBy(key).agg(F.concat(F.lit(system + "\n"), F.array_join(lines, "\n")).alias("prompt"))


def newest_first(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The list of a key's values, the newest first."""
    return items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))), asc=False), lambda x: x["v"]).alias("items"))


def latest_status(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def routed(kind: Column | str, branches: dict[str, str], other: str = "ignored") -> Column:
    """The branch of an event kind."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(other)
    for k, branch in branches.items():
        out = F.when(kind == k, branch).otherwise(out)
    return out
