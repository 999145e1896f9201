"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

A text becomes a vector of hashed features: its words, the shapes of its words (runs of lower case,
upper case, digits, and each mark as itself), and coarse statistics (shares of capitals and marks, repeated words, word
and line lengths) as terms of their own. Term weights are log(1 + tf) * idf, with document frequencies over all documents. A
truncated singular value decomposition of the labelled vectors gives the latent space. At most SAMPLE labelled
documents, those of the smallest hash of the id, are the neighbours; their latent vectors are broadcast. For every
document the cosines with all of them are computed in blocks, and the labels of the NEIGHBOURS nearest vote with
the weight of their similarity.

Null and empty texts: the vector of the statistics of nothing, scored like any other. No labels: score 0.5. Null labels
teach nothing; several labels or texts of one doc_id: the smallest of each teaches. A null doc_id is scored and not held out. Repeated rows are all
scored; of ties in similarity the neighbour of the smaller doc_id counts. Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fold, mix, per_text_sum, table, utf8, words

#: Labelled documents that are kept as neighbours, the bound of the fitted sample.
SAMPLE = 4096
NEIGHBOURS = 25
LATENT = 64
WORDS, SHAPES, STATISTICS = 2048, 1024, 128
FEATURES = WORDS + SHAPES + STATISTICS
#: A statistic counts as a term that occurs so often.
WEIGHT = 30
ROWS = 512
#: Digits to which similarities are compared.
DIGITS = 9
SCORED = "doc_id long, score double, predicted int"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x80:] = ord("a")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("u")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def counts(texts: pa.Array) -> np.ndarray:
    """How often each text has each feature: texts by FEATURES."""
    data, offsets = utf8(texts)
    w = words(data, offsets)
    n, of = len(texts), w.of()
    feature = (w.hashes % np.uint64(WORDS)).astype(np.int64)

    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    shaped = words(kinds[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
    shape = WORDS + (mix(shaped.hashes + np.uint64(3)) % np.uint64(SHAPES)).astype(np.int64)
    flat = np.concatenate([of * FEATURES + feature, shaped.of() * FEATURES + shape])
    out = np.bincount(flat, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)

    size = np.maximum(1, np.diff(offsets))
    share = lambda hit: per_text_sum(hit.astype(np.int64), offsets) / size
    number = np.maximum(1, np.diff(w.first))
    kinds_of_words = (out[:, :WORDS] > 0).sum(1)
    facts = [
        share((data >= 65) & (data <= 90)),
        share(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128))),
        share((data >= 48) & (data <= 57)),
        kinds_of_words / np.minimum(number, WORDS),
        np.minimum(1, size / number / 16),
        np.minimum(1, np.log2(1 + share(data == 10) * size) / 16),
        np.minimum(1, np.log2(number) / 16),
        per_text_sum(np.concatenate([[False], w.hashes[1:] == w.hashes[:-1]]).astype(np.int64)[: len(of)], w.first) / number,
    ]
    for k, x in enumerate(facts):
        level = np.minimum(15, (np.sqrt(x) * 16).astype(np.int64))
        for step, weight in ((0, WEIGHT), (-1, WEIGHT // 4), (1, WEIGHT // 4)):  # near levels resemble each other
            out[np.arange(n), WORDS + SHAPES + 16 * k + np.clip(level + step, 0, 15)] += weight
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunks(batches, "text"):
        for k in range(0, piece.num_rows, ROWS):
            yield piece.slice(k, ROWS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for part in _blocks(batches):
        df += (counts(part.column("text")) > 0).sum(0)
        n += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(df, n))], names=["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _blocks(batches):
        x = counts(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # features by latent
    vectors: np.ndarray  # neighbours by latent, of length 1
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        """In doubles, so that what the order of sums adds to equal vectors is far below the digits that are compared."""
        return _unit(_unit((np.log1p(x) * self.idf).astype(np.float64)) @ self.space)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = np.round(self.latent(x) @ self.vectors.T, DIGITS)
        weight = np.where(nearest(near, NEIGHBOURS), np.maximum(near, 1e-6), 0)
        return np.clip(weight @ self.labels / weight.sum(1), 0, 1)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Which k columns of each row are greatest, the first of those that tie."""
    if k >= near.shape[1]:
        return np.ones(near.shape, bool)
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    over, level = near > least, near == least
    return over | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - over.sum(1, keepdims=True)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _svd(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors of x, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, quality): frequencies from all docs, neighbours from the
    sample of the labelled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = texts.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(FEATURES + 1)
    held[df["feature"].to_numpy(np.int64)] = df["n"].to_numpy()
    idf = (np.log((held[-1] + 1) / (held[:-1] + 1)) + 0.3).astype(np.float32)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold("doc_id", 3) != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row an id however often it stands there, so `sample` rows
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = one.select("doc_id", "quality", "text").mapInArrow(_sampled, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    if not len(got):
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]])
    model = Model(idf, _svd(_unit(np.log1p(x) * idf), LATENT), np.zeros((0, 1), np.float32), got["quality"].to_numpy(np.float64))
    model.vectors = np.concatenate([model.latent(x[k : k + ROWS]) for k in range(0, len(x), ROWS)])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            s = shared.value.score(counts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", fold("doc_id", 3) == 1)
