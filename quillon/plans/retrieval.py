"""Similarity search and retrieval metrics over the embeddings table.

Searches take every vec_id divisible by 100 as a query. For metrics over two modalities the first half of
each vector stands for the image and the second for the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ranking, search
from ..sources.readers import table
from .registry import Registry

plans = Registry()


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.where("vec_id % 100 = 0"), rows


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_PAIRS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 {where}),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM p)
"""
_COS = "list_cosine_similarity(q.e, c.e)"


def _sql(score: str = _COS, where: str = "", k: int = 10) -> str:
    return _PAIRS.format(score=score, where=where) + f"SELECT query_id, rank, id, score FROM r WHERE rank <= {k}"


@plans.query(_sql())
def search_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.top_k(*_sides(spark, sf), 10))


@plans.query(_sql("list_inner_product(q.e, c.e)"))
def search_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.top_k(*_sides(spark, sf), 10, "dot"))


@plans.query(_sql("-list_distance(q.e, c.e)", "AND q.vec_id <> c.vec_id", 5))
def search_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.top_k(*_sides(spark, sf), 5, "l2", exclude_self=True))


@plans.query(_sql(where="AND list_cosine_similarity(q.e, c.e) >= 0.3", k=5))
def search_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.top_k(*_sides(spark, sf), 5, threshold=0.3))


@plans.query(_sql(where="AND q.vec_id <> c.vec_id", k=5))
def search_without_self(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.top_k(*_sides(spark, sf), 5, exclude_self=True))


@plans.query(_sql(where="JOIN documents d ON d.doc_id = c.vec_id AND d.lang = 'en' AND c.label = 1", k=5))
def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Payload filters are applied before the search."""
    queries, rows = _sides(spark, sf)
    held = rows.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    return _rounded(search.top_k(queries, held, 5, where=search.filters({"lang": "en", "label": 1})))


def _reference(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@plans.query("SELECT c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 10")
def search_one_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.nearest(table(spark, sf, "embeddings"), _reference(spark, sf), 10))


@plans.query("SELECT c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id = 0")
def reference_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """All rows against the reference row."""
    rows = table(spark, sf, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("r"))
    return _rounded(rows.join(F.broadcast(one), F.lit(True)).select(F.col("vec_id").alias("id"), V.cosine("embedding", "r").alias("score")))  # one row


@plans.query("SELECT c.vec_id AS id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id = 0 ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), id LIMIT 10")
def search_sharded(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.sharded_top_k(table(spark, sf, "embeddings"), _reference(spark, sf), 10, 4))


@plans.query("WITH s AS (SELECT list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id = 0 AND c.vec_id <> 0) SELECT CAST(least(floor((score + 1) * 20 / 2), 19) + 1 AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1")
def similarity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quality import histogram

    rows = table(spark, sf, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("r"))
    scores = rows.where("vec_id <> 0").join(F.broadcast(one), F.lit(True)).select(V.cosine("embedding", "r").alias("score"))  # one row
    return histogram(scores, "score", -1.0, 1.0, 20)


@plans.query(_PAIRS.format(score=_COS, where="") + "SELECT query_id, id, round(exp(20 * (s - max(s) OVER (PARTITION BY query_id))) / sum(exp(20 * (s - m))) OVER (PARTITION BY query_id), 6) AS share FROM (SELECT query_id, id, score AS s, max(score) OVER (PARTITION BY query_id) AS m FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)")
def search_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.softmax(search.top_k(*_sides(spark, sf), 10), 20.0).select("query_id", "id", "share"))


@plans.query(
    _PAIRS.format(score=_COS, where="")
    + """, t AS (SELECT r.query_id, r.id, r.rank AS was, d.n_chars % 7 AS s FROM r LEFT JOIN documents d ON d.doc_id = r.id AND d.lang <> 'de' WHERE rank <= 10)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, was, id) AS INTEGER) AS rank FROM t"""
)
def search_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best by cosine in the order of another score; those without one stand last."""
    found = search.top_k(*_sides(spark, sf), 10)
    scores = found.select("query_id", "id").join(table(spark, sf, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 7).alias("score")), "id")
    return search.rerank(found, scores).select("query_id", "id", "rank")


@plans.query(_PAIRS.format(score=_COS, where="") + "SELECT query_id, max(id) FILTER (rank = 1) AS best, max(id) FILTER (rank = 1) = query_id AS itself FROM r GROUP BY query_id")
def search_self_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(*_sides(spark, sf), 1).select("query_id", F.col("id").alias("best"), (F.col("id") == F.col("query_id")).alias("itself"))


_HALVES = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:32] AS img, CAST(embedding AS DOUBLE[])[33:64] AS txt FROM embeddings),
s AS (SELECT a.id AS i, b.id AS t, coalesce(list_cosine_similarity(a.img, b.txt), 0) AS s FROM v a, v b),
it AS (SELECT s.i AS query_id, 1 + count(*) FILTER (s.t <> s.i AND (s.s > d.s OR s.s = d.s AND s.t < s.i)) AS rank FROM s JOIN s d ON d.i = s.i AND d.t = s.i GROUP BY 1),
ti AS (SELECT s.t AS query_id, 1 + count(*) FILTER (s.t <> s.i AND (s.s > d.s OR s.s = d.s AND s.i < s.t)) AS rank FROM s JOIN s d ON d.t = s.t AND d.i = s.t GROUP BY 1)
"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return tuple(rows.select(F.col("vec_id").alias("id"), V.half("embedding", k, 64).alias("v")) for k in (0, 1))  # type: ignore[return-value]


def _suite(name: str, source: str) -> str:
    return "UNION ALL ".join(
        f"SELECT '{name}' AS direction, '{m}' AS metric, round({e}, 6) AS value FROM {source} "
        for m, e in [*((f"recall@{k}", f"avg(CAST(rank <= {k} AS DOUBLE))") for k in (1, 5, 10)), ("mrr", "avg(1.0 / rank)"), ("ndcg@5", "avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END)")]
    )


@plans.query(_HALVES + _suite("image_to_text", "it") + "UNION ALL " + _suite("text_to_image", "ti"))
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Recall, MRR and NDCG of both directions."""
    return _rounded(ranking.both_directions(*_halves(spark, sf)))


@plans.query(_HALVES + "SELECT query_id, rank FROM it")
def retrieval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranks(*_halves(spark, sf))


@plans.query(_HALVES + "SELECT rank, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM it GROUP BY rank")
def retrieval_rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ranking.rank_histogram(ranking.ranks(*_halves(spark, sf))))


@plans.query(
    _PAIRS.format(score=_COS, where="AND q.vec_id <> c.vec_id")
    + """, t AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
h AS (SELECT t.*, r.rank FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.id = t.id)
SELECT query_id, """
    + ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}" for k in (1, 5, 10))
    + ", round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM h GROUP BY query_id"
)
def retrieval_multi_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Several true items a query, those of its label, each by its rank among all rows."""
    queries, rows = _sides(spark, sf)
    side = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return _rounded(ranking.label_truth(side(queries), side(rows)))


@plans.query(_PAIRS.format(score=_COS, where="AND q.vec_id <> c.vec_id") + "SELECT q.label = c.label AS is_match, round(avg(r.score), 4) AS avg_score, count(*) AS n FROM r JOIN v q ON q.vec_id = r.query_id JOIN v c ON c.vec_id = r.id WHERE rank <= 10 GROUP BY 1")
def retrieval_match_averages(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _sides(spark, sf)
    found = search.top_k(queries, rows, 10, exclude_self=True)
    labels = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("l"))
    scored = found.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("l").alias("ql")), "query_id").select((F.col("l") == F.col("ql")).alias("is_match"), F.round("score", 6).alias("score"))
    return ranking.match_averages(scored).withColumn("avg_score", F.round("avg_score", 4))


@plans.query(
    _PAIRS.format(score="list_cosine_similarity(q.e, c.e) * 0.7 + list_inner_product(q.e, c.e) * 0.3", where="") + "SELECT query_id, id, score FROM r WHERE id = query_id"
)
def search_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Two scorings mixed, for each query's own row."""
    own, e = _sides(spark, sf)[0], F.col("embedding")
    score = V.cosine("embedding", "embedding") * 0.7 + V.dot("embedding", "embedding") * 0.3
    return _rounded(own.where(e.isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("id"), score.alias("score")))


@plans.query(_sql("list_cosine_similarity(q.e, c.e) * 0.7 + list_inner_product(q.e, c.e) * 0.3"))
def search_ensemble_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best by two scorings mixed, each candidate scored by both."""
    return _rounded(search.top_k(*_sides(spark, sf), 10, "mixed", weight=0.7))


@plans.query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:32] AS img, CAST(embedding AS DOUBLE[])[33:64] AS txt FROM embeddings) SELECT id, round(list_cosine_similarity(img, txt), 6) AS score FROM v")
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    images, texts = _halves(spark, sf)
    return _rounded(search.pair_scores(images.withColumnRenamed("v", "iv"), texts.withColumnRenamed("v", "tv"), "id", "iv", "tv").select("id", "score"))


@plans.query(
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT t.vec_id AS t, i.vec_id AS i, list_transform(list_zip(t.e, i.e), lambda p: (p[1] + p[2]) / 2) AS v FROM q t JOIN q i ON t.vec_id % 100 = 0)
SELECT t, i, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0) AS v FROM m WHERE list_inner_product(v, v) > 0"""
)
def combined_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every asked text with every image, averaged and normalised."""
    asked, rows = _sides(spark, sf)
    both = search.combine(asked.select(F.col("vec_id").alias("t"), V.doubles("embedding").alias("v")), rows.select(F.col("vec_id").alias("i"), V.doubles("embedding").alias("v")))
    return both.withColumn("v", F.transform("v", lambda x: F.round(x, 6) + 0.0))


@plans.query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.label, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.e, b.e)), 6) + 0.0 AS mean FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label"""
)
def same_label_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The mean cosine of all pairs of a label."""
    return ranking.label_means(table(spark, sf, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6) + 0.0)
