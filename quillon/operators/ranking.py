"""Retrieval metrics: ranks of true items, Recall@K, MRR, NDCG@K."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import stored
from .blocks import met, swept
from .search import CELLS, _fit, _matrix


#: Queries and items whose scores are held at once while better items are counted.
ROWS, ITEMS = 256, 1024
#: Pairs of a query and a true item in one block.
PAIRS = 1 << 22
#: Scores of its queries with all items that a task holds, as long as those of one query don't exceed it.
HELD = 1 << 24
#: Scores this close are ties, which go to the smaller id.
TIE = 1e-12


def ranks(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id and rank of the item with the query's own id among all items, by cosine (both: id, v).

    The rank is one more than the number of better items, ties going to the smaller id; blocks of queries meet blocks of
    items, and only the numbers leave a task. Vectors of length zero score 0."""
    rows = _fit(items, "id", "v", True)
    pairs = _fit(queries, "id", "v", True).join(rows.select("id", F.col("v").alias("t")), "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
        better = np.zeros(len(ids), np.int64)
        if len(ids) and len(own):
            q, t, c = (_unit(x) for x in (left.column("v"), left.column("t"), right.column("v")))
            truth = (q * t).sum(1)
            for at in range(0, len(ids), ROWS):
                part = slice(at, at + ROWS)
                high, low = truth[part, None] + TIE, truth[part, None] - TIE
                for col in range(0, len(own), ITEMS):
                    s = q[part] @ c[col : col + ITEMS].T
                    ahead, near = s > high, s >= low
                    n = np.count_nonzero(ahead, axis=1)
                    better[part] += n
                    if np.count_nonzero(near) > n.sum():  # ties, the item itself among them
                        row, at_col = np.nonzero(near & ~ahead)
                        better[part] += np.bincount(row[own[col + at_col] < ids[at + row]], minlength=len(n))
            order = np.argsort(own, kind="stable")
            first, last = (np.searchsorted(own[order], ids, side) for side in ("left", "right"))
            for k in np.flatnonzero(last - first > 1):  # an item of the query's own id is never ahead of itself
                better[k] -= int((c[order[first[k] : last[k]]] @ q[k] > truth[k] + TIE).sum())
        return pa.table([pa.array(ids.astype(np.int64)), pa.array(better)], names=["query_id", "better"])

    # the pairs are one a query id and item of that id
    counts = met(pairs, rows.select("id", "v"), run, "query_id long, better long", 1 << 14)
    return counts.groupBy("query_id").agg((F.sum("better") + 1).alias("rank"))


def true_ranks(queries: DataFrame, truth: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, id and rank of every true item (truth: query_id, id) of each query among all items but the query's own.

    The pairs carry the scores of the true items, not their vectors; a block of pairs holds each of its queries' vectors once."""
    rows, asked = _fit(items, "id", "v", True), _fit(queries, "id", "v", True)
    named = truth.select(F.col("query_id").alias("id"), F.col("id").alias("true_id"))
    both = named.join(rows.select(F.col("id").alias("true_id"), F.col("v").alias("t")), "true_id").join(asked, "id")
    pairs = stored(both.select("id", "true_id", F.coalesce(V.cosine("v", "t"), F.lit(0.0)).alias("truth")), "pairs")
    left = pairs.withColumn("v", F.lit(None).cast("array<double>")).unionByName(asked.select("id", F.lit(None).cast("long").alias("true_id"), F.lit(None).cast("double").alias("truth"), "v"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, asks = right.column("id").to_numpy(), left.filter(left.column("true_id").is_null())
        pairs = left.filter(left.column("true_id").is_valid()).sort_by("id")
        ids, true, truth = (pairs.column(c).to_numpy() for c in ("id", "true_id", "truth"))
        better = np.zeros(len(ids), np.int64)
        if len(ids) and len(own):
            q, c = _unit(asks.column("v")), _unit(right.column("v"))
            found, n = np.unique(own, return_counts=True)
            many = np.isin(true, found[n > 1])
            for k, i in enumerate(asks.column("id").to_numpy()):
                part = slice(*np.searchsorted(ids, [i, i + 1]))
                s = c @ q[k]
                s[own == i] = -np.inf
                order = np.argsort(s)
                high, low = (np.searchsorted(s[order], truth[part] + d, side) for d, side in ((TIE, "right"), (-TIE, "left")))
                better[part] = len(s) - high + _smaller(own[order], low, high, true[part])
                for p in np.flatnonzero(many[part]) + part.start:  # an item is never ahead of itself
                    better[p] -= int((s[own == true[p]] > truth[p] + TIE).sum())
        return pa.table([pa.array(ids.astype(np.int64)), pa.array(true.astype(np.int64)), pa.array(better)], names=["query_id", "id", "better"])

    counts = met(left, rows.select("id", "v"), run, "query_id long, id long, better long", PAIRS, few_vectors=True)
    return counts.groupBy("query_id", "id").agg((F.sum("better") + 1).alias("rank"))


def label_truth(queries: DataFrame, items: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """multi_truth over true_ranks where the true items of a query are those of its label (both: id, v, label), without a row a pair: query_id, recall@K and mrr.

    Packed blocks of items stream past the queries of a task, which keeps 8 bytes an item and query and gives a row a query. An item without a
    vector is true but found by nothing; of items that share an id each is an item, and true if one of them has the label, once for each that has."""
    def rows(df: DataFrame) -> DataFrame:
        fit = F.coalesce(V.is_finite("v"), F.lit(False))
        return df.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.when(fit, V.doubles("v")).alias("v"))

    names, kinds = ["ids", "labels", "known", "fit", "vectors"], [np.int64, np.int64, bool, bool, np.float64]

    def blobs(t: pa.Table | pa.RecordBatch) -> list[pa.Array]:
        label, v = t.column("label"), t.column("v")
        held = [t.column("id"), label.fill_null(0), label.is_valid(), v.is_valid()]
        plain = [x.to_numpy() if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False) for x in held]
        return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (*plain, _unit(v.drop_null()))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ITEMS):
                yield pa.RecordBatch.from_arrays(blobs(b.slice(at, ITEMS)), names=names)

    def bound(t: pa.Table) -> pa.Table:
        return pa.table([t.column("_q")[:1], *blobs(t)], names=["q_block", *(f"q_{c}" for c in names)])

    def read(batch: pa.RecordBatch, r: int, before: str = "") -> list[np.ndarray]:
        ids, labels, known, fit, flat = (np.frombuffer(batch.column(before + c)[r].as_py(), kind) for c, kind in zip(names, kinds, strict=True))
        return [ids, labels, known, fit, flat.reshape(fit.sum(), -1) if fit.any() else np.zeros((0, 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[np.ndarray]] = {}
        seen: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            for r in range(b.num_rows):
                key = b.column("q_block")[r].as_py()
                if key not in asked:
                    asked[key], seen[key] = read(b, r, "q_"), []
                ids, labels, known, fit, c = read(b, r)
                q = asked[key][4]
                seen[key].append((ids, labels, known, fit, q @ c.T if len(q) and len(c) else np.zeros((len(q), len(c)))))
        for key, (q_ids, q_labels, q_known, q_fit, _) in asked.items():
            ids, labels, known, fit = (np.concatenate([x[n] for x in seen[key]]) for n in range(4))
            own, place = np.unique(ids, return_inverse=True)
            found, out = np.cumsum(q_fit) - 1, []
            for k, i in enumerate(q_ids):
                times = (known & (labels == q_labels[k]) & (ids != i) & q_known[k]).astype(np.int64)
                if len(own) < len(ids):
                    times = np.bincount(place, times, len(own)).astype(np.int64)[place]
                others = ids[fit] != i
                true = times[fit][others]
                got = np.flatnonzero(true)
                rank = np.zeros(0)
                if q_fit[k]:
                    s = np.concatenate([x[4][found[k]] for x in seen[key]])[others]
                    order = np.argsort(s)
                    high, low = (np.searchsorted(s[order], s[got] + d, side) for d, side in ((TIE, "right"), (-TIE, "left")))
                    rank = 1 + len(s) - high + _smaller(ids[fit][others][order], low, high, ids[fit][others][got])
                n = true[got][: len(rank)]
                out.append([i, times.sum(), (n / rank).sum(), *(n[rank <= at].sum() for at in ks)])
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.float64() if n == 2 else pa.int64()) for n in range(3 + len(ks))], names=given)

    given = ["query_id", "n", "gain", *(f"hits_{k}" for k in ks)]
    held, own = stored(rows(items).mapInArrow(pack, ", ".join(f"{c} binary" for c in names)), "items"), rows(queries)
    many, cores = own.count(), items.sparkSession.sparkContext.defaultParallelism
    few = max(1, min(256, HELD // max(1, items.count())))
    blocks = max(1, -(-many // few), min(many, 2 * cores))
    packed = own.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("_q").applyInArrow(bound, "q_block int, " + ", ".join(f"q_{c} binary" for c in names))
    counts = swept(held, stored(packed, "asked"), run, ", ".join(f"{c} {'double' if c == 'gain' else 'long'}" for c in given), blocks, whole=True)
    whole = counts.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in given[1:]]).where("n > 0")
    return whole.select("query_id", *[(F.col(f"hits_{k}") / F.col("n")).alias(f"recall_{k}") for k in ks], (F.col("gain") / F.col("n")).alias("mrr"))


def _unit(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    m = _matrix(lists)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1)


def _smaller(own: np.ndarray, low: np.ndarray, high: np.ndarray, true: np.ndarray) -> np.ndarray:
    """How many of own[low:high] are smaller than each true id, at most CELLS looked at at once unless one range holds more."""
    size, out = high - low, np.zeros(len(true), np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(true):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        n = size[at:to]
        pair = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        out[at:to] = np.bincount(pair[own[place] < true[at:to][pair]], minlength=len(n))
        at = to
    return out


def recall_at(k: int) -> Column:
    return F.avg((F.col("rank") <= k).cast("double"))


def mrr() -> Column:
    return F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    """With one relevant item a query the ideal gain is 1."""
    return F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))


def suite(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ndcg: int = 5) -> DataFrame:
    """metric and value: Recall at each K, MRR and NDCG of ranks (query_id, rank), in one pass."""
    columns = [recall_at(k).alias(f"recall@{k}") for k in ks] + [mrr().alias("mrr"), ndcg_at(ndcg).alias(f"ndcg@{ndcg}")]
    return ranked.agg(*columns).unpivot([], [f"`{c}`" for c in [*(f"recall@{k}" for k in ks), "mrr", f"ndcg@{ndcg}"]], "metric", "value").withColumn("metric", F.replace("metric", F.lit("`"), F.lit("")))


def both_directions(images: DataFrame, texts: DataFrame) -> DataFrame:
    """direction, metric and value of image-to-text and text-to-image retrieval (both: id, v)."""
    there = suite(ranks(images, texts)).withColumn("direction", F.lit("image_to_text"))
    return there.unionByName(suite(ranks(texts, images)).withColumn("direction", F.lit("text_to_image"))).select("direction", "metric", "value")


def multi_truth(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10), size: int | None = None) -> DataFrame:
    """query_id, recall@K (hits / true items; null if K exceeds the `size` of the corpus, 0 without true items) and mrr over
    the true items (0 for one not found). found: query_id, id, rank; truth: query_id, id."""
    hit = truth.join(found, ["query_id", "id"], "left")
    columns = []
    for k in ks:
        share = F.try_divide(F.count(F.when(F.col("rank") <= k, 1)).cast("double"), F.count("*").cast("double"))
        columns.append((F.lit(None).cast("double") if size is not None and k > size else share).alias(f"recall_{k}"))
    return hit.groupBy("query_id").agg(*columns, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def rank_histogram(ranked: DataFrame) -> DataFrame:
    """rank, n and percent of a rank column."""
    counts = ranked.groupBy("rank").agg(F.count("*").alias("n"))
    whole = ranked.agg(F.count("*").alias("all"))
    return counts.join(F.broadcast(whole), F.lit(True)).select("rank", "n", (100.0 * F.col("n") / F.col("all")).alias("percent"))  # one row


def match_averages(scored: DataFrame) -> DataFrame:
    """Mean score of matching and other pairs (is_match, score)."""
    return scored.groupBy("is_match").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))


def label_means(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """label, n_pairs and mean: the mean cosine of all pairs of different rows of a label. With S the sum of a label's n unit vectors the pairs'
    cosines sum to |S|^2 - n, so no pair is made and a label with a third of all rows costs no more than its rows. Labels of one row: null."""
    unit = rows.select(label, V.normalize(vec, "null").alias("v")).where("v IS NOT NULL")
    sums = unit.select(label, F.posexplode("v").alias("place", "x")).groupBy(label, "place").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return whole.select(label, (pairs / 2).cast("long").alias("n_pairs"), F.try_divide(F.col("square") - F.col("n"), pairs).alias("mean"))
