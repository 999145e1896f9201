"""Statistics of embeddings and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions, rules
from ..functions import vectors as V
from ..operators import quality
from ..sources.readers import table
from .registry import Registry

plans = Registry()
_E = "CAST(embedding AS DOUBLE[])"


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.transform(c, lambda x: V.rounded(x, digits)).alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes])


@plans.query(
    f"""WITH x AS (SELECT label, unnest({_E}) AS x FROM embeddings), n AS (SELECT label, avg(sqrt(list_inner_product({_E}, {_E}))) AS s FROM embeddings GROUP BY label)
SELECT x.label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(any_value(n.s), 6) AS avg_norm, round(avg(CAST(x = 0 AS DOUBLE)), 6) AS zero_fraction
FROM x JOIN n ON n.label = x.label GROUP BY x.label"""
)
def embedding_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _r(quality.embedding_quality(table(spark, sf, "embeddings"), "embedding", "label"))


@plans.query(f"WITH x AS (SELECT label, unnest({_E}) AS x FROM embeddings) SELECT label, max(x) > 100 OR min(x) < -100 AS exploding, stddev_pop(x) < 0.01 OR avg(CAST(x = 0 AS DOUBLE)) > 0.5 AS vanishing FROM x GROUP BY label")
def embedding_flags(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.embedding_quality(table(spark, sf, "embeddings"), "embedding", "label")
    return found.select("label", quality.exploding().alias("exploding"), quality.vanishing().alias("vanishing"))


_STATS = f"""
WITH v AS (SELECT vec_id, {_E} AS e FROM embeddings),
s AS (SELECT vec_id, e, list_avg(e) AS mean, list_stddev_samp(e) AS std, list_min(e) AS low, list_max(e) AS high FROM v),
b AS (SELECT vec_id, unnest(list_transform(e, lambda x: least(floor((x - low) * 10 / nullif(high - low, 0)), 9))) AS b FROM s),
c AS (SELECT vec_id, b, count(*) AS c, sum(count(*)) OVER (PARTITION BY vec_id) AS n FROM b GROUP BY vec_id, b),
h AS (SELECT vec_id, sum(-(c / n) * log2(c / n)) AS entropy FROM c GROUP BY vec_id)
"""


@plans.query(_STATS + "SELECT s.vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS min, round(high, 6) AS max, round(entropy, 6) AS entropy FROM s JOIN h USING (vec_id)")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r(quality.vector_stats(table(spark, sf, "embeddings"), "vec_id", "embedding"))


@plans.query(_STATS + "SELECT CASE WHEN entropy > 2.5 THEN 'abstract' WHEN std > 0.3 THEN CASE WHEN mean > 0.1 THEN 'nature' ELSE 'urban' END WHEN mean > 0 THEN 'person' ELSE 'object' END AS category, count(*) AS n FROM s JOIN h USING (vec_id) GROUP BY 1")
def category_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(rules.category("embedding").alias("category")).agg(F.count("*").alias("n"))


#: What is asked of a row, by its id: a prompt for every branch of the rules, and none.
_PROMPTS = ["Describe the image", "What is the main subject?", "What is HAPPENING here?", "Which colours are there?", "Explain the embedding", None]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _list(texts: list) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


_CAPTIONS = (
    _STATS.replace(f"SELECT vec_id, {_E} AS e FROM embeddings", f"SELECT vec_id, CASE WHEN list_max(list_transform(x, lambda y: abs(y))) > 10 THEN list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) ELSE x END AS e FROM (SELECT vec_id, list_transform({_E}[1:3 + vec_id % 20], lambda y: y * power(2, vec_id % 9)) AS x FROM embeddings)")
    + f""", w AS (SELECT s.vec_id, mean, std, entropy, coalesce({_list(_PROMPTS)}[1 + vec_id % 6], '') AS prompt,
  CASE WHEN entropy > 2.5 THEN 'abstract' WHEN std > 0.3 AND mean > 0.1 THEN 'nature' WHEN std > 0.3 THEN 'urban' WHEN mean > 0 THEN 'person' ELSE 'object' END AS kind,
  (CASE WHEN std > 0.3 THEN {_list(captions.WORDS["high_variance"])} ELSE {_list(captions.WORDS["low_variance"])} END)[1 + CAST(floor(least(std * 10, 3)) AS INTEGER)] AS f1,
  (CASE WHEN mean > 0 THEN {_list(captions.WORDS["positive_bias"])} ELSE {_list(captions.WORDS["negative_bias"])} END)[1 + CAST(floor(least(abs(mean) * 10, 3)) AS INTEGER)] AS f2,
  (CASE WHEN entropy < 2 THEN {_list(captions.WORDS["clustered"])} ELSE {_list(captions.WORDS["dispersed"])} END)[1 + CAST(floor(least(entropy, 3)) AS INTEGER)] AS f3,
  CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 AS t, CAST('0x' || substr(md5(vec_id || 'a'), 1, 4) AS INTEGER) % 4 AS ta FROM s JOIN h USING (vec_id))
SELECT vec_id, CASE WHEN vec_id % 6 = 4 THEN replace(replace({_list(captions.ANALYSES)}[1 + ta], '{{category}}', kind), '{{feature}}', f1 || ', ' || f2 || ', and ' || f3)
  ELSE (CASE kind {" ".join(f"WHEN '{k}' THEN {_list(t)}[1 + t]" for k, t in captions.TEMPLATES.items())} END) || CASE vec_id % 6
    WHEN 0 THEN ' The visual content appears to have ' || f1 || ' and ' || f2 || ' qualities.'
    WHEN 1 THEN ' The main subject shows characteristics of ' || f1 || ' content with ' || f2 || ' aspects.'
    WHEN 2 THEN ' The scene depicts ' || kind || ' elements with ' || f1 || ' and ' || f3 || ' attributes.'
    ELSE ' Analysis reveals ' || f1 || ', ' || f2 || ', and ' || f3 || ' properties in the visual data.' END END AS caption FROM w"""
)


@plans.query(_CAPTIONS)
def rule_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of the heads of all vectors, of several lengths and sizes so that every category and word comes up."""
    rows = table(spark, sf, "embeddings")
    head = F.transform(F.slice(V.doubles("embedding"), F.lit(1), (F.col("vec_id") % 20 + 3).cast("int")), lambda x: x * F.pow(F.lit(2.0), F.col("vec_id") % 9))
    prompt = F.element_at(F.array(*map(F.lit, _PROMPTS)), (F.col("vec_id") % 6 + 1).cast("int"))
    return rows.select("vec_id", captions.caption(F.col("vec_id"), head, prompt).alias("caption"))


@plans.query(f"SELECT vec_id, round(list_min({_E}), 6) AS min, round(list_max({_E}), 6) AS max, round(list_avg({_E}), 6) AS mean, round(list_stddev_pop({_E}), 6) AS std FROM embeddings")
def row_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r(quality.row_stats(table(spark, sf, "embeddings"), "vec_id", "embedding"))


@plans.query(
    """WITH t AS (SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT field, count(v) AS n, round(coalesce(avg(length(v)), 0), 6) AS avg_length, CAST(coalesce(min(length(v)), 0) AS INTEGER) AS min_length, CAST(coalesce(max(length(v)), 0) AS INTEGER) AS max_length,
count(*) FILTER (starts_with(v, 'Error:') OR v = 'No image available for processing') AS errors FROM t GROUP BY field"""
)
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r(quality.text_stats(table(spark, sf, "documents"), ["text", "lang", "source"]))


@plans.query("SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS text, CAST(coalesce(length(source), 0) AS INTEGER) AS source FROM documents")
def length_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return quality.length_matrix(table(spark, sf, "documents"), "doc_id", ["text", "source"])


@plans.query(f"SELECT vec_id, list_transform({_E}, lambda x: round(x / greatest(sqrt(list_inner_product({_E}, {_E})), 1e-12), 6)) AS unit, round(sqrt(list_inner_product({_E}, {_E})), 6) AS size FROM embeddings")
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _r(table(spark, sf, "embeddings").select("vec_id", V.normalize("embedding", "eps").alias("unit"), V.norm("embedding").alias("size")))


@plans.query(
    f"""WITH v AS (SELECT vec_id, {_E} AS e FROM embeddings)
SELECT vec_id, list_transform(range(1, 33), lambda j: round((e[j] + e[j + 32]) / 2, 6)) AS narrow, list_transform(range(0, 130), lambda i: round(e[CAST(floor((CASE WHEN i < 128 THEN i ELSE i - 128 END) / 2) AS BIGINT) + 1], 6)) AS wide FROM v"""
)
def resized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _r(table(spark, sf, "embeddings").select("vec_id", V.downsample("embedding", 64, 32).alias("narrow"), V.upsample("embedding", 64, 130).alias("wide")))


@plans.query(f"SELECT vec_id, round(greatest(least(10 * {_E}[1], 1), -1), 6) AS clipped, len(list_filter({_E}, lambda x: isfinite(x))) = len(embedding) AS finite, len(embedding) = 64 AS fits, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def vector_checks(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return _r(table(spark, sf, "embeddings").select("vec_id", V.clip(10 * F.get(V.doubles(v), F.lit(0))).alias("clipped"), V.is_finite(v).alias("finite"), (F.size(v) == 64).alias("fits"), F.size(v).alias("size")))


@plans.query("SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS elements, count(DISTINCT vec_id) AS vectors FROM embeddings GROUP BY label")
def label_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.sum(F.size("embedding")).alias("elements"), F.countDistinct("vec_id").alias("vectors"))
