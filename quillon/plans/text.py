"""Text parsing and scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import readers
from ..sources.readers import table
from .registry import Registry

plans = Registry()


@plans.query("SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short, upper(replace(source || '_x', '_', ' ')) AS display FROM documents")
def shortened(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.shorten("text", 50).alias("short"), T.display_name(F.concat("source", F.lit("_x"))).alias("display"))


@plans.query("SELECT conv_id, turn, replace(text, chr(10), '') AS line FROM conversations")
def single_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.one_line("text").alias("line"))


@plans.query("SELECT doc_id, CASE WHEN contains(text, ' the ') THEN trim(substr(text, instr(text, ' the ') + 5)) ELSE trim(text) END AS answer FROM documents")
def answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.answer_after("text", F.lit(" the ")).alias("answer"))


@plans.query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'describe') THEN 'description' WHEN contains(lower(text), 'what') THEN 'identification' WHEN contains(lower(text), 'how many') THEN 'count' WHEN contains(lower(text), 'color') THEN 'color' WHEN contains(lower(text), 'where') THEN 'place' ELSE 'general' END AS kind FROM conversations")
def prompt_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.kind_of_prompt("text").alias("kind"))


@plans.query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers FROM documents")
def regex_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"))


@plans.query(
    """WITH l AS (SELECT CASE event_type WHEN 'click' THEN 'Processing rate: ' || CAST(CAST(event_id AS BIGINT) AS VARCHAR) || '.5 samples/sec' WHEN 'view' THEN 'Processing batch of size ' || (event_id % 9) ELSE 'Adjusting batch size from ' || (event_id % 7) || ' to ' || (event_id % 5) END AS line FROM events)
SELECT line, CASE WHEN starts_with(line, 'Processing r') THEN 'rate' WHEN starts_with(line, 'Processing b') THEN 'batch' ELSE 'adjust' END AS event, TRY_CAST(nullif(regexp_extract(line, 'rate: ([0-9.]+)', 1), '') AS DOUBLE) AS rate, TRY_CAST(nullif(regexp_extract(line, 'of size ([0-9]+)', 1), '') AS DOUBLE) AS size,
TRY_CAST(nullif(regexp_extract(line, 'from ([0-9]+)', 1), '') AS DOUBLE) AS old_size, TRY_CAST(nullif(regexp_extract(line, ' to ([0-9]+)', 1), '') AS DOUBLE) AS new_size FROM l"""
)
def parsed_log(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "click", F.format_string("Processing rate: %d.5 samples/sec", n))
        .when(F.col("event_type") == "view", F.format_string("Processing batch of size %d", n % 9))
        .otherwise(F.format_string("Adjusting batch size from %d to %d", n % 7, n % 5))
    )
    return readers.log_events(table(spark, sf, "events").select(line.alias("value")))


@plans.query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, list_last(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')) AS last_part FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.element_at(F.split(path, "/"), -1).alias("last_part"))


@plans.query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links FROM pages")
def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"))


@plans.query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, coalesce(props->>'$.missing', 'none') AS missing FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = readers.json_fields(table(spark, sf, "events"), "props", {"k": "$.k", "missing": "$.missing"})
    return found.select("event_id", F.col("k").cast("int").alias("k"), F.coalesce("missing", F.lit("none")).alias("missing"))


@plans.query("SELECT doc_id, list_transform(string_split(lang || ',' || source, ','), lambda t: replace(lower(trim(t)), ' ', '_')) AS items FROM documents")
def split_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.tasks(F.concat_ws(",", "lang", "source")).alias("items"))


@plans.query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def time_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@plans.query("SELECT conv_id, turn, starts_with(text, 'Error:') OR text = 'No image available for processing' AS error, starts_with(text, 'Error:') AS narrow FROM conversations")
def error_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_error("text").alias("error"), T.is_error("text", False).alias("narrow"))
