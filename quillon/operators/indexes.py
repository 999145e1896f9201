"""Approximate search over stored indexes: inverted lists behind a coarse quantiser, product codes, hyperplane hashes.

Every row is indexed. Quantisers and codebooks are fitted on SAMPLE rows at most, those with the least hash of their id, so
what is sent to tasks is bounded by parameters. Lists lie in Parquet files sorted by cell, so that a search reads the row groups of
the cells it probes. A few queries (ASKED numbers at most) go out to the lists where they lie; more of them meet the lists cell by
cell in blocks. Both ways give the same rows. Final scores are exact and ties go to the smaller id; what approximation costs is
recall, which InvertedLists.needed measures before a search. With all cells probed the result is that of search.top_k. Vectors of
length zero, null vectors and vectors with elements that are no finite numbers are found by nothing. All vectors have one length.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import stored
from .blocks import met_by
from .search import CELLS, _fit, _matrix, _scores, best

#: Rows that a quantiser or a codebook is fitted on, at most.
SAMPLE = 1 << 16
#: Cells of an index, and numbers of all its centroids, at most.
MAX_CELLS, MAX_VALUES = 1 << 16, 1 << 25
#: Numbers of all query vectors, and pairs of query and list, that are sent to every task, at most.
ASKED = 1 << 21
#: Codes a sub-vector has: one byte.
CODES = 256
METRICS = ("cosine", "dot", "l2")
FOUND = "query_id long, id long, score double"
#: Lists of each query vector, and scores of query vectors with the payload of list rows.
Route = Callable[[np.ndarray], np.ndarray]
Score = Callable[[np.ndarray, pa.Array], np.ndarray]


def _shaped(m: np.ndarray, metric: str) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" and m.size else m


def sampled(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows (id, v) of the least hashes of the id, `most` at most; the same on every run."""
    n, h = rows.count(), F.xxhash64("id", F.lit(7))
    part = rows if n <= 2 * most else rows.where(F.pmod(h, F.lit(n // (2 * most) + 1)) == 0)
    return part.orderBy(h, "id", "v").limit(most)


def centroids(rows: DataFrame, cells: int, rounds: int = 20, seed: int = 42, most: int = SAMPLE) -> np.ndarray:
    """Centroids of a sample of rows (id, v) by k-means; fewer than `cells` where the sample has fewer distinct vectors."""
    part = stored(sampled(rows, most).select(array_to_vector("v").alias("features")), "quantiser-sample")
    if part.isEmpty():
        raise ValueError("there is no vector to fit on")
    if cells == 1:
        return np.zeros((1, len(part.first()[0])))
    return np.array(KMeans(k=cells, maxIter=rounds, seed=seed).fit(part).clusterCenters())


def nearest(m: np.ndarray, c: np.ndarray, n: int, metric: str) -> np.ndarray:
    """The n centroids that each row is nearest to (for dot: has the greatest product with), in order, ties to the smaller cell."""
    out = np.zeros((len(m), min(n, len(c))), np.int32)
    step = max(1, CELLS // len(c))
    for at in range(0, len(m), step):
        far = -(m[at : at + step] @ c.T)
        if metric != "dot":
            far = (c * c).sum(1)[None] + 2 * far
        out[at : at + step] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, and of those that tie with the last of them. NaN is no score."""
    s = np.where(np.isnan(s), -np.inf, s)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
    return np.nonzero((s >= least[:, None]) & np.isfinite(s))


class _Held:
    """The k best rows of each query so far: at most 2 k a query and what came with the last block."""

    def __init__(self, k: int):
        self.k, self.row, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores s of the queries `rows` with list rows `ids`."""
        row, col = _top(s, self.k)
        row, found, score = np.concatenate([self.row, rows[row]]), np.concatenate([self.id, ids[col]]), np.concatenate([self.score, s[row, col]])
        keep = best(row, found, score, self.k)
        self.row, self.id, self.score = row[keep], found[keep], score[keep]

    def table(self, ids: np.ndarray) -> pa.Table:
        return pa.table([pa.array(ids[self.row].astype(np.int64)), pa.array(self.id), pa.array(self.score)], names=["query_id", "id", "score"])


def _answers(lists: DataFrame, on: str, payload: str, queries: DataFrame, route: Route, score: Score, k: int) -> DataFrame:
    """query_id, id and score of the k best rows of the lists (on, id, payload) that route gives each query (id, v), and more."""
    spark = lists.sparkSession
    head = queries.select(F.size("v").alias("n")).first()
    if head is None:
        return spark.createDataFrame([], FOUND)
    few = ASKED // max(head["n"], 1)
    asked = queries.limit(few + 1).toArrow()
    if asked.num_rows <= few:
        ids, q = asked.column("id").to_numpy(), _matrix(asked.column("v"))
        routes = route(q)
        if routes.size <= ASKED:
            return _sent(lists, on, payload, ids, q, routes, score, k)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                to = route(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int64)), *(b.column(c).take(pa.array(np.repeat(np.arange(b.num_rows), to.shape[1]))) for c in ("id", "v"))], names=["list", "id", "v"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        held, ids = _Held(k), left.column("id").to_numpy()
        if left.num_rows and right.num_rows:
            q, own, column = _matrix(left.column("v")), right.column("id").to_numpy(), right.column(payload).combine_chunks()
            step = max(1, CELLS // len(own))
            for at in range(0, len(ids), step):
                held.add(np.arange(at, min(at + step, len(ids))), own, score(q[at : at + step], column))
        return held.table(ids)

    away = queries.select("id", V.doubles("v").alias("v")).mapInArrow(routed, "list long, id long, v array<double>")
    return met_by("list", away, lists.select(F.col(on).cast("long").alias("list"), "id", payload), work, FOUND)


def _sent(lists: DataFrame, on: str, payload: str, ids: np.ndarray, q: np.ndarray, routes: np.ndarray, score: Score, k: int) -> DataFrame:
    """_answers for queries that are sent to the lists; each task keeps the k best of each query."""
    order = np.argsort(routes.ravel(), kind="stable")
    to, who = routes.ravel()[order], np.repeat(np.arange(len(ids)), routes.shape[1])[order]
    sent = lists.sparkSession.sparkContext.broadcast((ids, q, to, who))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, to, who = sent.value
        held = _Held(k)
        for b in batches:
            cell, own = b.column("list").to_numpy(), b.column("id").to_numpy()
            for c in np.unique(cell):
                rows = who[np.searchsorted(to, c) : np.searchsorted(to, c, "right")]
                at = np.flatnonzero(cell == c)
                step = max(1, CELLS // len(at))
                for x in range(0, len(rows), step):
                    held.add(rows[x : x + step], own[at], score(q[rows[x : x + step]], b.column(payload).take(pa.array(at))))
        yield from held.table(ids).to_batches()

    some = np.unique(to)
    probed = F.col(on).isin([int(x) for x in some]) if len(some) <= 1000 else F.col(on).between(int(some[0]), int(some[-1]))
    return lists.where(probed).select(F.col(on).cast("long").alias("list"), "id", payload).mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and score of the k best of found (query_id, id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _laid(df: DataFrame, on: str, path: str) -> None:
    """Appends df to a folder, sorted by `on`: by ranges of it and a hash, so that many tasks write a list with a third of all rows."""
    spread = df.withColumn("_h", F.xxhash64("id"))
    spread.repartitionByRange(on, "_h").sortWithinPartitions(on, "_h").drop("_h").write.mode("append").parquet(path)


class InvertedLists:
    """An index of vectors in lists by their nearest centroid, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        held = spark.read.parquet(f"{folder}/centroids").orderBy("cell").toArrow()  # MAX_VALUES numbers at most
        self.centroids, self.metric = _matrix(held.column("v")), held.column("metric")[0].as_py()
        self._out = spark.sparkContext.broadcast(self.centroids)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, cells: int, metric: str = "cosine", rounds: int = 20, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> InvertedLists:
        """Fits the quantiser on a sample and writes every row into the list of its cell."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if not 1 <= cells <= MAX_CELLS:
            raise ValueError(f"cells must lie between 1 and {MAX_CELLS}")
        fit = _fit(rows, id_col, vec_col, metric != "cosine")
        c = centroids(fit.withColumn("v", V.normalize("v")) if metric == "cosine" else fit, cells, rounds, seed, sample)
        if c.size > MAX_VALUES:
            raise ValueError(f"{len(c)} centroids of {c.shape[1]} numbers are more than {MAX_VALUES}")
        rows.sparkSession.createDataFrame([(k, x.tolist(), metric) for k, x in enumerate(c)], "cell int, v array<double>, metric string").coalesce(1).write.parquet(f"{folder}/centroids")
        out = cls(rows.sparkSession, folder)
        _laid(out.assigned(fit), "cell", f"{folder}/lists")
        return out

    def add(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Appends rows to their lists; the quantiser stays as it is."""
        _laid(self.assigned(_fit(rows, id_col, vec_col, self.metric != "cosine")), "cell", f"{self.folder}/lists")

    def assigned(self, fit: DataFrame) -> DataFrame:
        """cell, id and v of rows (id, v)."""
        sent, metric = self._out, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = nearest(_shaped(_matrix(b.column("v")), metric), sent.value, 1, "l2")[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("id"), b.column("v")], names=["cell", "id", "v"])

        return fit.select("id", "v").mapInArrow(run, "cell int, id long, v array<double>")

    def lists(self) -> DataFrame:
        """cell, id and v of every row."""
        return self.spark.read.schema("cell int, id long, v array<double>").parquet(f"{self.folder}/lists")

    def sizes(self) -> DataFrame:
        """cell and n of every list that has rows."""
        return self.lists().groupBy("cell").agg(F.count("*").alias("n"))

    def route(self, probes: int) -> Route:
        sent, metric = self._out, self.metric
        return lambda m: nearest(_shaped(m, metric), sent.value, probes, metric)

    def queries(self, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        return _fit(queries, id_col, vec_col, self.metric != "cosine")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 1, among: DataFrame | None = None, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank (from 1), id and score of the k best rows in the `probes` lists nearest to each query. among (id): only
        these rows take part. metric l2 scores by the negative distance."""
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be at least 1")
        metric = self.metric
        lists = self.lists() if among is None else self.lists().join(among.select("id"), "id", "left_semi")
        found = _answers(lists, "cell", "v", self.queries(queries, query_id, vector), self.route(probes), lambda q, v: _scores(q, _matrix(v), metric), k)
        return ranked(found, k)

    def needed(self, queries: DataFrame, k: int = 10, query_id: str = "vec_id", vector: str = "embedding", most: int = 256) -> DataFrame:
        """probes and recall: what share of the k truly best rows the lists nearest to a query hold, for every number of probes that
        adds some. Measured on `most` queries at most (those of the least hashes) against all rows."""
        q = stored(sampled(self.queries(queries, query_id, vector), most), "asked")
        truth = self.search(q, k, len(self.centroids), query_id="id", vector="v").select("query_id", "id")
        cells = truth.join(self.lists().select("id", "cell").distinct(), "id").join(q.select(F.col("id").alias("query_id"), "v"), "query_id")
        route = self.route(len(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    place = (route(_matrix(b.column("v"))) == b.column("cell").to_numpy()[:, None]).argmax(1) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32))], names=["probes"])

        at = cells.select("cell", "v").mapInArrow(run, "probes int").groupBy("probes").agg(F.count("*").alias("n"))
        # a row for each number of probes: MAX_CELLS at most
        return at.select("probes", (F.sum("n").over(Window.orderBy("probes")) / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("recall"))

    def probes_for(self, queries: DataFrame, recall: float, k: int = 10, query_id: str = "vec_id", vector: str = "embedding") -> int:
        """The least number of probes that reaches a recall on the queries that needed measures."""
        found = self.needed(queries, k, query_id, vector).where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
        return found or len(self.centroids)


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids of the rows of x, starting from rows drawn by seed; a centroid without rows stays."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds if len(distinct) > k else 0):
        own = nearest(x, c, 1, "l2")[:, 0]
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.concatenate([c, np.repeat(c[:1], k - len(c), axis=0)])


class ProductCodes:
    """The rows of inverted lists as one byte a sub-vector, in a folder: lists are searched by their codes, and the best
    candidates are scored anew by their vectors."""

    def __init__(self, lists: InvertedLists, folder: str):
        self.lists, self.spark, self.folder = lists, lists.spark, folder
        held = self.spark.read.parquet(f"{folder}/codebooks").orderBy("part", "code").toArrow()  # parts x CODES rows
        self.books = _matrix(held.column("x")).reshape(-1, CODES, len(held.column("x")[0]))
        self._out = self.spark.sparkContext.broadcast(self.books)

    @classmethod
    def build(cls, lists: InvertedLists, folder: str, parts: int = 16, rounds: int = 12, seed: int = 42, sample: int = SAMPLE) -> ProductCodes:
        """Fits a codebook for each of `parts` sub-vectors, each in a task of its own, and codes every row."""
        width = lists.centroids.shape[1]
        if parts < 1 or width % parts:
            raise ValueError(f"{width} elements are no multiple of {parts} parts")
        step, metric = width // parts, lists.metric
        rows = sampled(lists.lists().select("id", V.normalize("v").alias("v") if metric == "cosine" else "v"), sample)
        pieces = stored(rows.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.slice("v", j * step + 1, step))).alias("part", "x")), "codebook-sample")

        def fitted(own: pa.Table) -> pa.Table:
            c = _lloyd(_matrix(own.column("x")), CODES, rounds, seed)
            return pa.table([pa.array([own.column("part")[0].as_py()] * CODES, pa.int32()), pa.array(range(CODES), pa.int32()), pa.array(list(c))], names=["part", "code", "x"])

        pieces.groupBy("part").applyInArrow(fitted, "part int, code int, x array<double>").coalesce(1).write.parquet(f"{folder}/codebooks")
        out = cls(lists, folder)
        _laid(out.coded(lists.lists()), "cell", f"{folder}/codes")
        return out

    def coded(self, rows: DataFrame) -> DataFrame:
        """cell, id and code of rows (cell, id, v)."""
        sent, metric = self._out, self.lists.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m, step = _shaped(_matrix(b.column("v")), metric), sent.value.shape[2]
                    codes = np.stack([nearest(m[:, j * step : (j + 1) * step], book, 1, "l2")[:, 0] for j, book in enumerate(sent.value)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

        return rows.mapInArrow(run, "cell int, id long, code binary")

    def codes(self) -> DataFrame:
        return self.spark.read.schema("cell int, id long, code binary").parquet(f"{self.folder}/codes")

    def score(self) -> Score:
        """Scores of queries with codes: sums over the parts of a table of each query's products (l2: squared distances) with the codebook."""
        sent, metric = self._out, self.lists.metric

        def run(q: np.ndarray, codes: pa.Array) -> np.ndarray:
            books, q = sent.value, _shaped(q, metric)
            parts = q.reshape(len(q), len(books), -1)
            held = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(books))
            out = np.zeros((len(q), len(held)))
            for j, book in enumerate(books):
                table = parts[:, j] @ book.T if metric != "l2" else -((parts[:, j, None] - book[None]) ** 2).sum(2)
                out += table[:, held[:, j]]
            return out

        return run

    def candidates(self, queries: DataFrame, n: int, probes: int, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, id and approximate score of the n best rows by their codes."""
        found = _answers(self.codes(), "cell", "code", self.lists.queries(queries, query_id, vector), self.lists.route(probes), self.score(), n)
        return ranked(found, n)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 1, candidates: int = 100, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, id and exact score of the k best of the candidates."""
        if not 1 <= k <= candidates:
            raise ValueError("k must lie between 1 and the number of candidates")
        q = self.lists.queries(queries, query_id, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        found = self.candidates(queries, candidates, probes, query_id, vector).select("query_id", "id").distinct()
        pairs = found.join(self.lists.lists().select("id", "v"), "id").join(q.dropDuplicates(["query_id"]), "query_id")
        score = {"cosine": V.cosine, "dot": V.dot, "l2": lambda a, b: -V.l2_distance(a, b)}[self.lists.metric]("q", "v")
        return ranked(pairs.select("query_id", "id", score.alias("score")), k)


class HyperplaneTables:
    """Rows in buckets by the signs of their products with random directions, in several tables, in a folder. Each table holds every
    row with its vector, so an index takes `tables` times the room of its rows, and pairs of rows never leave a task."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        held = spark.read.parquet(f"{folder}/planes").orderBy("plane").toArrow()
        self.bits = held.column("bits")[0].as_py()
        self._out = spark.sparkContext.broadcast(_matrix(held.column("v")).reshape(-1, self.bits, len(held.column("v")[0])))

    @classmethod
    def build(cls, rows: DataFrame, folder: str, tables: int = 8, bits: int = 8, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> HyperplaneTables:
        """bits: 2 ** bits buckets a table."""
        if not 1 <= bits <= 16 or not 1 <= tables <= 64:
            raise ValueError("bits must lie between 1 and 16, tables between 1 and 64")
        spark, fit = rows.sparkSession, _fit(rows, id_col, vec_col, False)
        head = fit.select(F.size("v")).first()
        planes = np.random.default_rng(seed).standard_normal((tables * bits, head[0] if head else 1))
        spark.createDataFrame([(k, x.tolist(), bits) for k, x in enumerate(planes)], "plane int, v array<double>, bits int").coalesce(1).write.parquet(f"{folder}/planes")
        out = cls(spark, folder)
        route = out.route(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    to = route(_matrix(b.column("v")))
                    for t in range(to.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(to[:, t].astype(np.int32)), b.column("id"), b.column("v")], names=["bucket", "id", "v"])

        _laid(fit.mapInArrow(run, "bucket int, id long, v array<double>"), "bucket", f"{folder}/buckets")
        return out

    def buckets(self) -> DataFrame:
        return self.spark.read.schema("bucket int, id long, v array<double>").parquet(f"{self.folder}/buckets")

    def route(self, probes: int) -> Route:
        """In each table the bucket of a vector, and those it misses by the least: probes - 1 sets of the few bits that
        are nearest to turning, by the sum of their squared products."""
        sent, bits = self._out, self.bits
        low = min(bits, 8)
        sets = np.array(list(itertools.product((0, 1), repeat=low)))

        def run(m: np.ndarray) -> np.ndarray:
            out = []
            for t, planes in enumerate(sent.value):
                s = m @ planes.T
                base = ((s > 0) << np.arange(bits)[::-1]).sum(1)
                near = np.argsort(np.abs(s), axis=1, kind="stable")[:, :low]
                cost = np.take_along_axis(s * s, near, 1) @ sets.T
                pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                flips = (sets[pick] << (bits - 1 - near)[:, None, :]).sum(2)
                out.append((t << bits) | (base[:, None] ^ flips))
            return np.concatenate(out, axis=1)

        return run

    def search(self, queries: DataFrame, k: int = 10, probes: int = 1, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, id and cosine of the k best rows in the buckets that each query probes."""
        if k < 1 or not 1 <= probes <= 2 ** min(self.bits, 8):
            raise ValueError(f"k must be at least 1, and probes lie between 1 and {2 ** min(self.bits, 8)}")
        found = _answers(self.buckets(), "bucket", "v", _fit(queries, query_id, vector, False), self.route(probes), lambda q, v: _scores(q, _matrix(v), "cosine"), k * len(self._out.value))
        # every table may find the same row, so the k best rows are among the k * tables best finds
        return ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)
