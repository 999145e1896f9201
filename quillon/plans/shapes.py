"""Columns found by name, rows looked up, vectors under conditions, maps, tables as text, running bests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import cache, quality, records, search
from ..operators import telemetry as op
from ..sources.readers import table
from .registry import Registry
from .telemetry import BY, batches

plans = Registry()
_E = "CAST(embedding AS DOUBLE[])"
_T = "WITH t AS (SELECT event_id, user_id, event_type, ts, value, CAST(props->>'$.k' AS INTEGER) % 64 + 1 AS batch_size FROM events)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id"


@plans.query("SELECT doc_id AS image_id, text AS caption FROM documents")
def unified_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of an image and its text, whatever the source calls them."""
    rows = records.require(table(spark, sf, "documents").withColumnRenamed("doc_id", "pixel_values"), ["pixel_values", "text"])
    return rows.select(F.col(records.first_present(rows, records.IMAGE_NAMES)).alias("image_id"), F.col(records.first_present(rows, records.TEXT_NAMES)).alias("caption"))


@plans.query("SELECT vec_id, model, CAST(len(embedding) AS INTEGER) AS size FROM embeddings, (VALUES ('b_img_embedding'), ('b_txt_embedding')) AS m(model)")
def vector_columns_long(spark: SparkSession, sf: str) -> DataFrame:
    """A row per vector column, found by the end of its name."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("b_img_embedding"), F.col("embedding").alias("b_txt_embedding"), "label")
    found = quality.vector_columns(rows)
    return records.long(rows.select("vec_id", *[F.size(c).alias(c) for c in found]), ["vec_id"], found, "model", "size")


@plans.query("SELECT conv_id, turn, m.model, CAST(length(text) AS INTEGER) AS value FROM conversations, (VALUES ('llava_said'), ('qwen_said')) AS m(model)")
def output_columns_long(spark: SparkSession, sf: str) -> DataFrame:
    """A row per text output, found by the start of its name."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("llava_said"), F.col("text").alias("qwen_said"), F.lit(0).alias("llava_embedding"))
    found = quality.output_columns(rows)
    return records.long(rows.select("conv_id", "turn", *[F.char_length(c).alias(c) for c in found]), ["conv_id", "turn"], found, "model", "value")


@plans.query("SELECT vec_id, CAST(to_json({'vec_id': vec_id, 'label': label}) AS VARCHAR) AS payload FROM embeddings")
def payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", records.payload(rows, ["embedding"]).alias("payload"))


@plans.query("SELECT a.doc_id, d.lang, d.doc_id IS NOT NULL AS found FROM (SELECT item_id * 7 AS doc_id FROM benchmark) a LEFT JOIN documents d ON d.doc_id = a.doc_id")
def row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by asked ordinals, some of them out of bounds."""
    asked = table(spark, sf, "benchmark").select((F.col("item_id") * 7).alias("doc_id"))
    return records.rows_at(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", asked)


@plans.query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return records.head(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)


@plans.query(f"SELECT vec_id, CASE WHEN label % 3 > 0 THEN list_transform({_E}, lambda x: round(x / sqrt(list_inner_product({_E}, {_E})), 6)) END AS unit FROM embeddings")
def unit_or_null(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors at length 1 by plain division; those of length zero have none."""
    v = F.transform(V.doubles("embedding"), lambda x: F.when(F.col("label") % 3 > 0, x).otherwise(0.0))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.normalize(v, "null"), lambda x: V.rounded(x)).alias("unit"))


@plans.query(
    f"""WITH v AS (SELECT vec_id, list_transform({_E}, lambda x: x * (label % 3) * 40) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN list_max(list_transform(v, lambda y: abs(y))) > 10 THEN x / sqrt(list_inner_product(v, v)) ELSE x END, 6) + 0.0) AS v FROM v"""
)
def large_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Only vectors with an element over 10 are normalised."""
    v = F.transform(V.doubles("embedding"), lambda x: x * (F.col("label") % 3) * 40)
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.transform(V.normalize_if_large("v"), lambda x: F.round(x, 6) + 0.0).alias("v"))


@plans.query(f"SELECT vec_id, list_transform(range(0, 24), lambda j: round(list_avg(({_E})[j * len(embedding) // 24 + 1 : ((j + 1) * len(embedding) + 23) // 24]), 6)) AS pooled FROM embeddings")
def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors narrowed to 24 elements, which need not divide their size."""
    rows = table(spark, sf, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 24
    return rows.select("vec_id", F.transform(V.pooled("embedding", size, 24), lambda x: V.rounded(x)).alias("pooled"))


@plans.query(f"SELECT vec_id, CAST(2 * len(embedding) AS INTEGER) AS size, ({_E})[1] AS first, coalesce(({_E})[1000], -1) AS beyond FROM embeddings")
def flattened(spark: SparkSession, sf: str) -> DataFrame:
    """Nested arrays made flat, elements by place with a default."""
    flat = F.flatten(F.array(V.doubles("embedding"), V.doubles("embedding")))
    element = lambda k: F.try_element_at(V.doubles("embedding"), F.lit(k))
    return table(spark, sf, "embeddings").select("vec_id", F.size(flat).alias("size"), element(1).alias("first"), F.coalesce(element(1000), F.lit(-1.0)).alias("beyond"))


@plans.query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS bare FROM documents")
def stripped_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without their namespace; others stay."""
    key = F.when(F.col("doc_id") % 2 == 0, T.cache_key("source", "clip:")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", T.strip_namespace(key, "clip:").alias("bare"))


@plans.query("SELECT n_nationkey, upper(left(n_name, 1)) || lower(substr(n_name, 2)) || '_' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS title FROM nation")
def titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", T.title(F.concat_ws("_", "n_name", "n_name")).alias("title"))


@plans.query("SELECT CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id AS VARCHAR) ELSE md5(text) END AS conv_id, turn FROM conversations")
def filled_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("conv_id", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")))
    return records.missing_ids(rows, "conv_id", "text").select("conv_id", "turn")


@plans.query("SELECT event_id, 'k,id,score' AS fields, CAST(event_id AS VARCHAR) AS id, props->>'$.k' AS k, 'none' AS missing FROM events")
def merged_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Id, score and payload as one map, read with defaults."""
    payload = F.from_json("props", "map<string,string>")
    found = records.with_payload(table(spark, sf, "events"), {"id": F.col("event_id"), "score": F.floor("value")}, payload)
    order = F.array_sort(F.map_keys("entry"), lambda a, b: F.when(F.char_length(a) == F.char_length(b), 0).otherwise(F.char_length(a) - F.char_length(b)))
    entry = lambda k: F.try_element_at("entry", F.lit(k))
    return found.select("event_id", F.array_join(order, ",").alias("fields"), entry("id").alias("id"), entry("k").alias("k"), F.coalesce(entry("missing"), F.lit("none")).alias("missing"))


@plans.query("SELECT n_nationkey AS id, n_name AS name, NULL AS region, 'nation' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey, 'region' FROM region")
def result_union(spark: SparkSession, sf: str) -> DataFrame:
    """Result sets one after the other; a column that one lacks is null there."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"), F.lit("region").alias("kind"))
    return records.concatenated([nations, regions]).select("id", "name", "region", "kind")


_TABLE = "SELECT row_number() OVER (ORDER BY n_nationkey) AS line_no, {row} AS line FROM nation UNION ALL SELECT -1, {head} UNION ALL SELECT 0, {rule}"


@plans.query(_TABLE.format(row="'| ' || n_nationkey || ' | ' || n_name || ' |'", head="'| n_nationkey | n_name |'", rule="'| --- | --- |'"))
def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    return records.markdown(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@plans.query(_TABLE.format(row=r"n_nationkey || ' & ' || n_name || ' \\'", head=r"'n_nationkey & n_name \\'", rule=r"'\hline'"))
def latex_table(spark: SparkSession, sf: str) -> DataFrame:
    return records.latex(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@plans.query(_T + " SELECT avg(batch_size) AS avg_batch_size, avg(floor(value)) AS avg_seconds, avg(CASE WHEN event_id % 5 > 0 THEN floor(value) END) AS avg_memory FROM t")
def whole_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of all numeric columns of a whole table; rows without memory do not count there."""
    rows = batches(spark, sf).select("batch_size", F.floor("value").cast("double").alias("seconds"), F.when(F.col("event_id") % 5 > 0, F.floor("value")).cast("double").alias("memory"))
    return op.means(rows)


@plans.query(
    _T
    + " SELECT batch_size, avg(CASE WHEN event_id % 5 > 0 THEN floor(value) END) AS mean, coalesce(CAST(sum(CASE WHEN event_id % 5 > 0 THEN floor(value) END) AS DOUBLE) / nullif(sum(CASE WHEN event_id % 5 > 0 THEN batch_size END), 0), 0) AS per_sample FROM t GROUP BY batch_size"
)
def memory_per_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches(spark, sf).withColumn("memory", F.when(F.col("event_id") % 5 > 0, F.floor("value")))
    return op.per_sample(rows, "memory", "batch_size", "batch_size")


@plans.query("SELECT CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) / count(*) AS click, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / count(*) AS view FROM events")
def event_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of kinds, as of instructions."""
    kinds = ["click", "view"]
    found = op.rates(table(spark, sf, "events"), [(F.col("event_type") == k).cast("int") for k in kinds], F.lit(1))
    return table(spark, sf, "events").agg(*[c.alias(k) for c, k in zip(found, kinds, strict=True)])


@plans.query(
    _T + f", b AS (SELECT *, max(value) OVER {_W} ROWS UNBOUNDED PRECEDING) AS best FROM t) SELECT event_id, best, (SELECT x.batch_size FROM t x WHERE x.user_id = b.user_id AND x.value = b.best ORDER BY x.ts, x.event_id LIMIT 1) AS best_at FROM b"
)
def best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest value of each stream up to each row, and the batch size of its first row."""
    return op.best_so_far(batches(spark, sf), BY, "value", "batch_size").select("event_id", "best", "best_at")


@plans.query(
    _T
    + f""", d AS (SELECT *, CAST(sign(batch_size - lag(batch_size) OVER {_W})) AS INTEGER) AS direction FROM t),
n AS (SELECT *, CAST(direction IS DISTINCT FROM lag(direction) OVER {_W}) AS INTEGER) AS fresh FROM d),
r AS (SELECT *, sum(fresh) OVER {_W} ROWS UNBOUNDED PRECEDING) AS run FROM n),
c AS (SELECT event_id, CASE WHEN direction <> 0 THEN CAST((row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 3 + 1 AS INTEGER) ELSE 0 END AS counter FROM r)
SELECT event_id, counter, counter = 3 AS fires FROM c"""
)
def reset_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Rises or falls in a row, counted anew after three."""
    return op.reset_runs(batches(spark, sf), BY, "batch_size").select("event_id", "counter", "fires")


@plans.query(
    """SELECT count(*) FILTER (value > 10) AS hits, count(*) FILTER (NOT value > 10) AS misses, count(*) AS total, count(DISTINCT user_id) AS keys,
CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS uptime_s, coalesce(CAST(count(*) FILTER (value > 10) AS DOUBLE) / nullif(count(value), 0), 0) AS hit_rate FROM events"""
)
def cache_overview(spark: SparkSession, sf: str) -> DataFrame:
    return cache.overview(table(spark, sf, "events"), "user_id", "ts", F.col("value") > 10)


@plans.query(
    """WITH s AS (SELECT conv_id AS query_id, turn AS id, CASE WHEN role = 'user' THEN CAST(turn % 3 AS DOUBLE) ELSE 0.0 END AS score FROM conversations)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s"""
)
def search_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of a query by new scores that only some have; the others stand at 0."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), "role")
    return search.rescored(rows, rows.where("role = 'user'").select("query_id", "id", (F.col("id") % 3).cast("double").alias("score")))
