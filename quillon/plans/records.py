"""Records: joins by key, unions, upserts, pivots, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources.readers import table
from .registry import Registry

plans = Registry()
PROMPTS = [("summary", "Describe it."), ("detail", "Tell more.")]


@plans.query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@plans.query("WITH c AS (SELECT doc_id, 'new' AS text FROM labels UNION ALL SELECT doc_id + 1000000, 'new' FROM labels) SELECT doc_id, text FROM c UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("version"))
    labels = table(spark, sf, "labels").select("doc_id", F.lit("new").alias("text"), F.lit(1).alias("version"))
    return records.upsert(base, labels.union(labels.withColumn("doc_id", F.col("doc_id") + 1000000)), ["doc_id"], ["version"]).select("doc_id", "text")


@plans.query("SELECT 'documents' AS model, doc_id AS id FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark UNION ALL SELECT 'embeddings', vec_id FROM embeddings")
def stacked_sources(spark: SparkSession, sf: str) -> DataFrame:
    ids = {"documents": "doc_id", "benchmark": "item_id", "embeddings": "vec_id"}
    return records.stacked({n: table(spark, sf, n).select(F.col(c).alias("id")) for n, c in ids.items()}).select("model", "id")


@plans.query("SELECT lang, max(n) FILTER (source = 'src1') AS src1, max(n) FILTER (source = 'src2') AS src2 FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def pivoted(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return records.wide(counts, "lang", "source", "n", ["src1", "src2"])


@plans.query("SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivoted(spark: SparkSession, sf: str) -> DataFrame:
    return records.long(table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


@plans.query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def shuffled_head(spark: SparkSession, sf: str) -> DataFrame:
    return records.shuffled_head(table(spark, sf, "documents"), "doc_id", 100).select("doc_id", "lang")


@plans.query("SELECT coalesce(d.doc_id, e.vec_id) AS ordinal, d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL AS complete FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def zipped(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), "lang")
    return records.zipped(left, table(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), "label"), "ordinal").select("ordinal", "complete")


@plans.query("SELECT item_id, name, prompt FROM benchmark, (VALUES ('summary', 'Describe it.'), ('detail', 'Tell more.')) AS p(name, prompt)")
def with_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return records.with_prompts(table(spark, sf, "benchmark").select("item_id"), PROMPTS)


@plans.query("SELECT d.doc_id, l.doc_id IS NOT NULL AS exists FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def existing(spark: SparkSession, sf: str) -> DataFrame:
    return records.existing(table(spark, sf, "documents").select("doc_id"), "doc_id", table(spark, sf, "labels"))


@plans.query("SELECT doc_id, 'sample_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    return records.ids(table(spark, sf, "documents").select("doc_id"), ["doc_id"], prefix="sample_")


@plans.query("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang", "source").distinct()


@plans.query("SELECT doc_id, coalesce(text, 'Unknown') AS caption, CASE WHEN starts_with(source, '/') THEN source ELSE '/data/' || source END AS path FROM documents")
def captions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", records.caption(rows).alias("caption"), records.absolute("source", "/data/").alias("path"))


@plans.query("SELECT vec_id, '[' || len(embedding) || ' float values]' AS embedding, label FROM embeddings")
def blank_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return records.blank_arrays(table(spark, sf, "embeddings"))


@plans.query("WITH p AS (SELECT batch, avg(v) AS cpu FROM (SELECT CAST(l_quantity AS INTEGER) AS batch, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1), g AS (SELECT CAST(l_quantity AS INTEGER) AS batch, avg(l_extendedprice) AS gpu FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 25 GROUP BY 1) SELECT batch, cpu, coalesce(printf('%.2f', gpu), 'N/A') AS gpu FROM p LEFT JOIN g USING (batch)")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Two result sets by batch size, one in cents so that its sums are exact; the second may lack rows."""
    rows = table(spark, sf, "lineitem").withColumn("batch", F.col("l_quantity").cast("int"))
    cpu = rows.where("l_returnflag = 'N'").groupBy("batch").agg(F.avg(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cpu"))
    gpu = rows.where("l_returnflag = 'R' AND l_quantity < 25").groupBy("batch").agg(F.avg("l_extendedprice").alias("g"))
    return cpu.join(gpu, "batch", "left").select("batch", "cpu", F.when(F.col("g").isNull(), "N/A").otherwise(F.format_string("%.2f", "g")).alias("gpu"))


@plans.query("SELECT item_id, seq FROM (SELECT item_id, item_id * 2 AS seq FROM benchmark UNION ALL SELECT doc_id, doc_id * 2 + 1 FROM documents)")
def interleaved(spark: SparkSession, sf: str) -> DataFrame:
    sides = [table(spark, sf, "benchmark").select("item_id"), table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))]
    return records.interleaved(sides, "item_id").select("item_id", "seq")
