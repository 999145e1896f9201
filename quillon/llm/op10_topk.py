"""Exact top-k search by inner product over paged M-trees, best first.

Components x become floor(256 * x); the score is the integer inner product. Vectors are routed to the nearest of a
few pivots (at most some 2 * PIVOTS, chosen by the hash of the id) and laid into pages of about PAGE vectors, so that a page holds near
vectors. A page is an M-tree: leaves of near vectors, each with its center, its covering radius, the distances of its
vectors to its center and the distance of its center to that of the page; the page has a center and a radius as well.
As the largest inner product is no metric, one component is added to every vector, sqrt(M^2 - |v|^2) for the page's largest
norm M, and 0 to the query: then |q - v|^2 = |q|^2 + M^2 - 2 q.v is Euclidean and falls as the score grows.

A query first looks into the page that promises most, which gives it a least score. Then only pages whose bound
reaches this score are opened for it, and within a page the leaves in the order of their bounds, all queries of a task
at once in strides of 1, 1, 2, 4, ... leaves each; by the triangle inequality over the stored distances, leaves and entries
whose bounds lie below the k-th best score are never computed. Bounds are widened by more than the rounding error and
entries that tie with the k-th score are computed, so results are exact, ties going to the smaller vec_id.

The centers of all pages go out only while there are at most DIRECTORY of them; with more, every page is opened for
every query. Queries meet pages in a cogroup, at most about QUERIES of them and GROUP pages a task; nothing of either goes
through the driver. Only vectors of a query's own dimension are its candidates. Null vectors, vectors with null or non-finite
components, and null vec_ids take no part. Rows that share a vec_id are each a candidate, and each a query, the best of all
pairs being the ranks of their common query_id; none of its own id is its candidate. Scores are exact while their terms stay below
2^53. Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

PAGE, LEAF, GROUP = 4096, 64, 16
PIVOTS, DIRECTORY = 512, 1 << 15
QUERIES = 1 << 16
FOUND = "query_id long, vec_id long, score long"
PAGES = "page long, dim int, ids binary, vectors binary, center binary, radius double, top double"


def _valid(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim and the integer vector (doubles) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dim"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")
    )


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _parts(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Groups of at most `size` near points: every point joins the nearest of evenly spread routing points."""
    n = -(-len(points) // size)
    own = _squares(points, points[np.linspace(0, len(points) - 1, n).astype(np.int64)]).argmin(1)
    order = np.argsort(own, kind="stable")
    return [p[k : k + size] for p in np.split(order, np.searchsorted(own[order], np.arange(1, n))) for k in range(0, len(p), size)]


def _lifted(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    norms = (vectors * vectors).sum(1)
    return np.hstack([vectors, np.sqrt(norms.max() - norms)[:, None]]), float(norms.max())


def bounds(reach: np.ndarray, away: np.ndarray) -> np.ndarray:
    """The highest score at a distance of `away` or more; reach: |q|^2 + M^2 of each query, by row."""
    return (reach - np.maximum(away, 0.0) ** 2) / 2 + 1e-9 * (reach + 1) + 1e-3


class MTree:
    """The M-tree of one page: vectors (rows by dimension) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        points, self.top = _lifted(vectors)
        self.leaves = _parts(points, LEAF)
        self.center = points.mean(0)
        self.centers = np.stack([points[x].mean(0) for x in self.leaves])
        self.away = [np.linalg.norm(points[x] - c, axis=1) for x, c in zip(self.leaves, self.centers, strict=True)]
        self.radii = np.array([x.max() for x in self.away])
        self.to_page = np.linalg.norm(self.centers - self.center, axis=1)
        self.computed = 0  # products so far

    def search(self, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (its id and vector) the k best scores of at least `least` and their ids (score -inf: none),
        scores falling and ids rising in ties."""
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        point = np.hstack([q, np.zeros((len(q), 1))])
        reach = ((q * q).sum(1) + self.top)[:, None]
        floor = least.copy()
        page = np.sqrt(_squares(point, self.center[None]))
        some = np.flatnonzero((bounds(reach, np.abs(page - self.to_page) - self.radii) >= floor[:, None]).any(0))  # by stored distances only
        far = np.sqrt(_squares(point, self.centers[some]))
        hope = bounds(reach, far - self.radii[some])
        turn = np.argsort(np.argsort(-hope, axis=1, kind="stable"), axis=1)
        begin, end = 0, 1
        while begin < len(some):
            for j, leaf in enumerate(some):
                asks = np.flatnonzero((turn[:, j] >= begin) & (turn[:, j] < end) & (hope[:, j] >= floor))
                if not len(asks):
                    continue
                near = bounds(reach[asks], np.abs(far[asks, j][:, None] - self.away[leaf])) >= floor[asks][:, None]
                entries = np.flatnonzero(near.any(0))
                if not len(entries):
                    continue
                rows = self.leaves[leaf][entries]
                got = np.where(self.ids[rows] == own[asks][:, None], -np.inf, q[asks] @ self.vectors[rows].T)
                self.computed += got.size
                better = (got >= floor[asks][:, None]).any(1)
                asks, got = asks[better], got[better]
                if len(asks):
                    got = np.where(got >= floor[asks][:, None], got, -np.inf)
                    scores[asks], ids[asks] = _merged(np.hstack([scores[asks], got]), np.hstack([ids[asks], np.broadcast_to(self.ids[rows], got.shape)]), k)
                    floor[asks] = np.maximum(floor[asks], scores[asks, -1])
            begin, end = end, 2 * end
        return scores, ids


def _merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties going to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _route(shared):
    """cell: the nearest pivot of a vector's dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                pivots = shared.value.get(int(d))
                cell = np.zeros(part.num_rows, np.int32) if pivots is None else _squares(_matrix(part.column("v"), int(d)), pivots).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], names=[*part.schema.names, "cell"])

    return run


def _page(t: pa.Table) -> pa.Table:
    dim = t.column("dim")[0].as_py()
    vectors = _matrix(t.column("v"), dim)
    points, top = _lifted(vectors)
    center = points.mean(0)
    ids = t.column("vec_id").to_numpy().astype(np.int64)
    values = [t.column("page")[0].as_py()], [dim], [ids.tobytes()], [vectors.tobytes()], [center.tobytes()], [float(np.linalg.norm(points - center, axis=1).max())], [top]
    types = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()
    return pa.table([pa.array(v, x) for v, x in zip(values, types, strict=True)], names=["page", "dim", "ids", "vectors", "center", "radius", "top"])


def pages_of(valid: DataFrame) -> DataFrame:
    """The pages of valid (row, vec_id, dim, v)."""
    spark = valid.sparkSession
    sizes = valid.groupBy("dim").agg(F.count("*").alias("size"))  # a row a dimension
    share = F.least(F.ceil(F.col("size") / PAGE), F.lit(PIVOTS)) * 2 / F.col("size")
    chosen = valid.join(F.broadcast(sizes), "dim").where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 40)) / float(1 << 40) < share).select("dim", "v").toPandas()  # 2 * PIVOTS expected
    pivots = {int(d): np.stack([np.asarray(x) for x in own["v"]]) for d, own in chosen.groupby("dim")}
    routed = stored(valid.mapInArrow(_route(spark.sparkContext.broadcast(pivots)), "row long, vec_id long, dim int, v array<double>, cell int"), "routed")
    cells = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PAGE).alias("parts")).orderBy("dim", "cell").collect()  # a row a pivot
    base = np.concatenate([[0], np.cumsum([r["parts"] for r in cells])]).tolist()
    places = spark.createDataFrame([(r["dim"], r["cell"], r["parts"], b) for r, b in zip(cells, base, strict=False)], "dim int, cell int, parts long, base long")
    laid = routed.join(F.broadcast(places), ["dim", "cell"]).withColumn("page", F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts")))
    return stored(laid.select("page", "dim", "vec_id", "v").groupBy("page").applyInArrow(_page, PAGES), "pages")


def _promising(shared):
    """home: the page of the highest bound; pages: all whose bound reaches the least score, by groups of `per`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, per = shared.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                if int(d) not in directory:
                    continue
                page, center, radius, top = directory[int(d)]
                whole = b.filter(pa.array(dims == d))
                for part in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                    q = _matrix(part.column("v"), int(d))
                    away = np.sqrt(_squares(np.hstack([q, np.zeros((len(q), 1))]), center)) - radius
                    hope = bounds((q * q).sum(1)[:, None] + top, away)
                    groups = [np.unique(page[x] // per) for x in hope >= part.column("least").to_numpy()[:, None]]
                    own = [part.column(c) for c in ("row", "vec_id", "dim", "v", "least")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(page[hope.argmax(1)]), pa.array(groups, pa.list_(pa.int64()))], names=["row", "vec_id", "dim", "v", "least", "home", "groups"])

    return run


def _searched(k: int, floors: bool):
    """The k best of the pages of a group for its queries; floors: only the k-th score of each."""

    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        n = queries.num_rows
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        own, least, dims, rows = (queries.column(c).to_numpy() for c in ("vec_id", "least", "dim", "row"))
        for page in pages.to_batches(max_chunksize=1):
            if not page.num_rows:
                continue
            dim = page.column("dim")[0].as_py()
            mine = np.flatnonzero(dims == dim)
            if not len(mine):
                continue
            tree = MTree(np.frombuffer(page.column("ids")[0].as_buffer(), np.int64), np.frombuffer(page.column("vectors")[0].as_buffer(), np.float64).reshape(-1, dim))
            q = _matrix(queries.column("v").take(pa.array(mine)), dim)
            s, i = tree.search(own[mine], q, k, np.maximum(least[mine], scores[mine, -1]))
            scores[mine], ids[mine] = _merged(np.hstack([scores[mine], s]), np.hstack([ids[mine], i]), k)
        if floors:
            return pa.table([pa.array(rows), pa.array(scores[:, -1])], names=["row", "least"])
        some = np.isfinite(scores)
        return pa.table([pa.array(np.repeat(own, k)[some.ravel()].astype(np.int64)), pa.array(ids[some]), pa.array(scores[some].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each row of queries with the rows of
    vectors (both vec_id, embedding)."""
    spark = vectors.sparkSession
    pages = pages_of(stored(_valid(vectors), "vectors"))
    asked = stored(_valid(queries).withColumn("least", F.lit(float("-inf"))), "queries")
    count, many = pages.count(), asked.count()
    per = max(1, min(GROUP, count // (2 * spark.sparkContext.defaultParallelism)))
    if count <= DIRECTORY:
        directory: dict[int, tuple] = {}
        for d, own in pages.select("page", "dim", "center", "radius", "top").toPandas().groupby("dim"):  # DIRECTORY rows at most
            directory[int(d)] = own["page"].to_numpy(np.int64), np.stack([np.frombuffer(c) for c in own["center"]]), own["radius"].to_numpy(), own["top"].to_numpy()
        shared = spark.sparkContext.broadcast((directory, per))
        shape = "row long, vec_id long, dim int, v array<double>, least double, home long, groups array<long>"
        homes = stored(asked.mapInArrow(_promising(shared), shape).drop("groups"), "homes")
        parts = homes.groupBy("home").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))  # a row a page
        left = homes.join(F.broadcast(parts), "home").select("row", "vec_id", "dim", "v", "least", F.col("home").alias("g"), F.pmod(F.xxhash64("row"), F.col("parts")).alias("l"))
        right = pages.join(F.broadcast(parts.withColumnRenamed("home", "page")), "page").select(F.col("page").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("l"), "dim", "ids", "vectors")
        least = left.groupBy("g", "l").cogroup(right.groupBy("g", "l")).applyInArrow(_searched(k, True), "row long, least double")
        asked = asked.drop("least").join(least, "row")
        asked = stored(asked.select("row", "vec_id", "dim", "v", "least").mapInArrow(_promising(shared), shape).withColumn("g", F.explode("groups")), "asked")
    else:
        asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // per).cast("long"))))
    blocks = max(1, -(-many // QUERIES))
    left = asked.select("row", "vec_id", "dim", "v", "least", "g", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("l"))
    right = pages.select(F.floor(F.col("page") / per).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("l"), "dim", "ids", "vectors")
    out = left.groupBy("g", "l").cogroup(right.groupBy("g", "l")).applyInArrow(_searched(k, False), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
