"""Search over a graph of nearest neighbours.

Building: in each round every row goes to the nearest of some drawn pivots, rows are sorted by pivot and by their product with a
drawn direction, and each stretch of BLOCK rows in that order is compared in full. So a round is one shuffle of the rows whatever
the skew, and no group is compared as a whole. Lists of all rounds are merged; then neighbours of neighbours are tried (descent).
Searching: a beam of the best rows found so far is expanded hop by hop with joins, until no row of any beam is left to expand.
Every row is a node; pivots and entry rows are drawn from a bounded sample. Scores are cosines, ties go to the smaller
id. Rows with a null, zero or non-finite vector are no nodes; of a repeated id the row with the greatest vector is the node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import stored
from .indexes import MAX_VALUES, _top, nearest, ranked, sampled
from .search import _fit, _matrix, best

#: Rows that are compared with each other at once.
BLOCK = 512
#: Rows from which a search begins, at most.
ENTRIES = 256
EDGES = "id long, to long, score double"


def _best(edges: DataFrame, key: str, other: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), other)
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def _round(nodes: DataFrame, pivots: np.ndarray, along: np.ndarray, degree: int, block: int, parts: int) -> DataFrame:
    """Edges between rows that meet in a block. parts: partitions that blocks are cut in, each of several blocks."""
    sent = nodes.sparkSession.sparkContext.broadcast((pivots, along))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, along = sent.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(nearest(m, pivots, 1, "l2")[:, 0]), pa.array(m @ along)], names=["id", "v", "pivot", "x"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            while size >= 2 * block:  # the last block takes what is left, so that no row is alone
                rows = pa.Table.from_batches(held)
                yield _edges(rows.slice(0, block), degree)
                rest = rows.slice(block)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield _edges(pa.Table.from_batches(held), degree)

    spread = nodes.mapInArrow(placed, "id long, v array<double>, pivot int, x double").repartitionByRange(parts, "pivot", "x", "id").sortWithinPartitions("pivot", "x", "id")
    return spread.select("id", "v").mapInArrow(met, EDGES)


def _edges(rows: pa.Table, degree: int) -> pa.RecordBatch:
    ids, m = rows.column("id").to_numpy(), _matrix(rows.column("v"))
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    row, col = _top(s, degree)
    keep = best(row, ids[col], s[row, col], degree)
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[col]), pa.array(s[row, col])], names=["id", "to", "score"])


class NeighbourGraph:
    """A graph in a folder: id, v (at length 1) and near (its neighbours, the nearest first) of every node."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, rows: DataFrame, folder: str, degree: int = 16, rounds: int = 4, descents: int = 1, reach: int = 4, block: int = BLOCK, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> NeighbourGraph:
        """degree: neighbours of a node. In a descent each node tries the `reach` nearest of its `reach` nearest."""
        if min(degree, rounds, reach) < 1 or block <= degree:
            raise ValueError("degree, rounds and reach must be at least 1, and a block must hold more rows than the degree")
        spark, draw = rows.sparkSession, np.random.default_rng(seed)
        unit = _fit(rows, id_col, vec_col, False).select("id", V.normalize("v").alias("v"))
        nodes = stored(unit.groupBy("id").agg(F.max("v").alias("v")), "nodes")
        n = nodes.count()
        if not n:
            raise ValueError("there is no vector to build on")
        pool = _matrix(sampled(nodes).select("v").toArrow().column("v")) if n > 1 else np.zeros((1, 1))
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * block)))
        edges: DataFrame | None = None
        for _ in range(rounds if n > 1 else 0):
            many = max(1, min(n // block, len(pool), MAX_VALUES // pool.shape[1]))
            part = _round(nodes, pool[draw.permutation(len(pool))[:many]], draw.standard_normal(pool.shape[1]), degree, block, parts)
            edges = part if edges is None else edges.union(part)
        edges = spark.createDataFrame([], EDGES) if edges is None else _best(edges.groupBy("id", "to").agg(F.max("score").alias("score")), "id", "to", degree)
        for _ in range(descents):
            edges = stored(edges, "edges")
            short = _best(edges, "id", "to", reach)
            two = short.select("id", F.col("to").alias("via")).join(short.select(F.col("id").alias("via"), F.col("to").alias("to")), "via").where("id <> to")
            fresh = two.select("id", "to").distinct().join(edges.select("id", "to"), ["id", "to"], "left_anti")
            vec = lambda c: nodes.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
            scored = fresh.join(vec("id"), "id").join(vec("to"), "to").select("id", "to", V.dot("v_id", "v_to").alias("score"))
            edges = _best(edges.union(scored), "id", "to", degree)
        order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "to"))), lambda e: e["to"])
        near = edges.groupBy("id").agg(order.alias("near"))  # degree edges a node
        full = nodes.join(near, "id", "left").select("id", "v", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
        full.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/graph")
        return cls(spark, folder)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, near array<long>").parquet(f"{self.folder}/graph")

    def search(self, queries: DataFrame, k: int = 10, beam: int = 64, hops: int = 32, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank (from 1), id and score of the k best rows that a beam reaches from the entry rows. hops bounds the rounds;
        a search that is not done by then: RuntimeError. Each hop joins the rows to expand with the graph and what
        they lead to with the vectors; what is carried on is `beam` rows a query."""
        if not 1 <= k <= beam:
            raise ValueError("k must lie between 1 and the beam")
        nodes = self.nodes()
        asked = stored(_fit(queries, query_id, vector, False).groupBy(F.col("id").alias("query_id")).agg(F.max(V.normalize("v")).alias("q")), "asked")
        held = sampled(nodes.select("id", "v"), ENTRIES).toArrow()
        sent = self.spark.sparkContext.broadcast((held.column("id").to_numpy(), _matrix(held.column("v"))))

        def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            for b in batches:
                if b.num_rows:
                    s = _matrix(b.column("q")) @ m.T
                    row, col = _top(s, beam)
                    keep = best(row, ids[col], s[row, col], beam)
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(row[keep])), pa.array(ids[col[keep]]), pa.array(s[row[keep], col[keep]]), pa.array(np.ones(len(keep), bool))], names=["query_id", "id", "score", "open"])

        beams = stored(asked.mapInArrow(entered, "query_id long, id long, score double, open boolean"), "beams")
        for _ in range(hops):
            ahead = beams.where("open").select("query_id", "id")
            if ahead.isEmpty():
                return ranked(beams.select("query_id", "id", "score"), k)
            led = ahead.join(nodes.select("id", "near"), "id").select("query_id", F.explode("near").alias("id")).distinct()
            led = led.join(beams.select("query_id", "id"), ["query_id", "id"], "left_anti")
            scored = led.join(nodes.select("id", "v"), "id").join(asked, "query_id").select("query_id", "id", V.dot("q", "v").alias("score"), F.lit(True).alias("open"))
            beams = stored(_best(beams.withColumn("open", F.lit(False)).union(scored), "query_id", "id", beam), "beams")
        raise RuntimeError(f"the search was not done after {hops} hops")
