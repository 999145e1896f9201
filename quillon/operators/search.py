"""Similarity search and similarity matrices.

Blocks of queries meet blocks of the corpus, and a task keeps k rows a query, so no N x M pairs leave a task and nothing passes
the driver; products are worked out at most CELLS at a time. Ties go to the smaller id. Vectors of length zero and null vectors are found by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import stored
from .blocks import crossed, met

#: Scores that are held at once.
CELLS = 1 << 21
METRICS = ("cosine", "dot", "l2", "mixed")


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _scores(q: np.ndarray, c: np.ndarray, metric: str, weight: float = 0.5) -> np.ndarray:
    s = q @ c.T
    if metric == "mixed":
        return weight * _scores(q, c, "cosine") + (1 - weight) * s
    if metric == "cosine":
        s = s / np.sqrt((q * q).sum(1)[:, None] * (c * c).sum(1)[None, :])
    elif metric == "l2":
        s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * s, 0))
    return s


def best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores of each row, ties going to the smaller id."""
    order = np.lexsort((ids, -scores, row))
    own = row[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < k]


def _fit(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    out = df.select(F.col(id_col).cast("long").alias("id"), V.doubles(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & V.is_finite("v"))
    return out if zero else out.where(V.dot("v", "v") > 0)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", where: Column | None = None, threshold: float | None = None, exclude_self: bool = False, query_id: str = "vec_id", corpus_id: str = "vec_id", vector: str = "embedding", weight: float = 0.5) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best rows of the corpus for each query.

    where filters the corpus before the search; threshold drops lower scores. metric l2 scores by the
    negative distance, mixed by weight * cosine + (1 - weight) * dot of every candidate. k larger than the corpus: all of it. All vectors have one length."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "cosine" and threshold is not None and not -1 <= threshold <= 1:
        raise ValueError("threshold must lie between -1 and 1")
    corpus = corpus if where is None else corpus.where(where)
    rows, asked = _fit(corpus, corpus_id, vector, metric in ("dot", "l2")), _fit(queries, query_id, vector, metric in ("dot", "l2"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q, own = left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy()
        c = _matrix(right.column("v"))
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        step = max(1, CELLS // max(1, len(own)))
        for at in range(0, len(ids) if len(own) else 0, step):
            s = _scores(q[at : at + step], c, metric, weight)
            if exclude_self:
                s = np.where(own[None] == ids[at : at + step, None], -np.inf, s)
            if threshold is not None:
                s = np.where(s >= threshold, s, -np.inf)
            s = np.where(np.isnan(s), -np.inf, s)
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
            row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            keep = best(row, own[col], s[row, col], k)
            for n, part in enumerate((row[keep] + at, own[col[keep]], s[row[keep], col[keep]])):
                held[n] = np.concatenate([held[n], part])
        return pa.table([pa.array(ids[held[0]].astype(np.int64)), pa.array(held[1].astype(np.int64)), pa.array(held[2])], names=["query_id", "id", "score"])

    out = met(asked, rows, run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(corpus: DataFrame, vector: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and score of the k rows nearest to one given vector: a projection and a top-k, all in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    score = {"cosine": V.cosine, "dot": V.dot, "l2": lambda a, b: -V.l2_distance(a, b)}[metric](vec_col, q)
    rows = corpus if where is None else corpus.where(where)
    rows = rows.select(F.col(id_col).alias("id"), score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def sharded_top_k(corpus: DataFrame, vector: list[float], k: int, shards: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and distance of the k nearest by Euclidean distance: k of each shard, then k of those."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = corpus.select(F.col(id_col).alias("id"), V.l2_distance(vec_col, q).alias("distance"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard")).where("distance IS NOT NULL")
    order = Window.partitionBy("shard").orderBy("distance", "id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).orderBy("distance", "id").limit(k).select("id", "distance")


def filters(wanted: dict[str, object]) -> Column:
    """Equality with every given value."""
    return V.all_of([F.col(c) == F.lit(v) for c, v in wanted.items()])


def pair_scores(left: DataFrame, right: DataFrame, on: str, left_vec: str, right_vec: str) -> DataFrame:
    """Cosine of the rows of both sides that share a key (same item, or same label)."""
    return left.join(right, on).withColumn("score", V.cosine(left_vec, right_vec))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (query_id, id, rank) ordered anew by scores (query_id, id, score); candidates without a score stand last, in their old order."""
    joined = candidates.select("query_id", "id", F.col("rank").alias("was")).join(scores, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "was", "id")
    return joined.withColumn("rank", F.row_number().over(order))


def rescored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (query_id, id) by new scores (query_id, id, score), 0 for all others."""
    joined = candidates.select("query_id", "id").join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def softmax(scores: DataFrame, scale: float = 100.0) -> DataFrame:
    """scores (query_id, id, score) with the softmax of scale * score within each query."""
    own = Window.partitionBy("query_id")
    raised = F.exp(scale * (F.col("score") - F.max("score").over(own)))
    return scores.withColumn("e", raised).withColumn("share", F.col("e") / F.sum("e").over(own)).drop("e")


def expanded(queries: DataFrame, corpus: DataFrame, hits: int = 10, against: int = 0, rounds: int = 1, keep: float = 1.0, toward: float = 0.75, away: float = 0.15, query_id: str = "vec_id", corpus_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Queries moved by relevance feedback: query_id and v, at length 1. In each round v becomes keep * v + toward * the mean of the `hits`
    best rows - away * the mean of the `against` rows ranked behind them, all at length 1. A query that finds nothing stays; of a
    repeated query or row id the greatest vector counts. A round is one search and one aggregation of hits + against rows a query."""
    if rounds < 1 or hits < 1 or against < 0:
        raise ValueError("rounds and hits must be at least 1, against at least 0")
    one = lambda df, i, name: _fit(df, i, vector, False).groupBy(F.col("id").alias(name)).agg(F.max(V.normalize("v")).alias("v"))
    rows, asked = one(corpus, corpus_id, "id"), one(queries, query_id, "query_id")
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    times = lambda a, x: F.transform(a, lambda y: y * x)
    for _ in range(rounds):
        found = top_k(asked, rows, hits + against, query_id="query_id", corpus_id="id", vector="v").join(rows, "id")
        near = F.sort_array(F.collect_list(F.struct("rank", "v")))  # hits + against rows
        moved = asked.join(found.groupBy("query_id").agg(near.alias("near")), "query_id", "left")

        def mean(own: Column) -> Column:
            none = F.transform("v", lambda x: x * 0.0)
            return times(F.aggregate(own, none, lambda s, r: plus(s, r["v"])), F.try_divide(F.lit(1.0), F.size(own)))

        good, bad = F.filter("near", lambda r: r["rank"] <= hits), F.filter("near", lambda r: r["rank"] > hits)
        v = F.when(F.size(good) > 0, plus(times(F.col("v"), F.lit(keep)), times(mean(good), F.lit(toward)))).otherwise(F.col("v"))
        moved = moved.withColumn("v", v).withColumn("v", F.when(F.size(bad) > 0, plus("v", times(mean(bad), F.lit(-away)))).otherwise(F.col("v")))
        asked = stored(moved.select("query_id", V.normalize("v").alias("v")), "expanded")
    return asked


def combine(texts: DataFrame, images: DataFrame, normalize: bool = True) -> DataFrame:
    """Every text of a request with every image as (t + i) / 2. texts (t, v), images (i, v), all vectors of one length; an empty side: the other
    as it is. Blocks of both sides meet, so neither side is sent out whole, and each is shuffled once; a null vector has no pairs."""
    if texts.isEmpty() or images.isEmpty():
        t = texts.select("t", F.lit(None).cast("long").alias("i"), V.doubles("v").alias("v"))
        return t.union(images.select(F.lit(None).cast("long").alias("t"), "i", V.doubles("v").alias("v")))

    def run(left: pa.RecordBatch, right: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, a, i, b = left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v"))
        step = max(1, CELLS // max(1, b.size))
        for at in range(0, len(t), step):
            m = (a[at : at + step, None] + b[None]) / 2
            if normalize:
                size = np.sqrt((m * m).sum(2, keepdims=True))
                m = m / np.where(size > 0, size, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) * len(i) + 1, dtype=np.int32) * m.shape[2]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t[at : at + step], len(i))), pa.array(np.tile(i, len(m))), lists], names=["t", "i", "v"])

    side = lambda df, key: df.select(F.col(key).cast("long").alias("id"), V.doubles("v").alias("v")).where("v IS NOT NULL")
    return crossed(side(texts, "t"), side(images, "i"), run, "t long, i long, v array<double>")
