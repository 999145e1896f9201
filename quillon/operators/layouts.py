"""Maps of vectors in the plane by a fuzzy graph of nearest neighbours.

LANDMARKS rows at most are laid out by gradient steps: each pulls its neighbours by the strength of their link and is pushed from drawn
rows. Every row is then placed among its nearest landmarks, by the same strengths; so the layout costs the same at any size, and
placing is one pass over the rows where they lie. The same seed gives the same map. Rows with a null, zero or non-finite vector have no place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import search
from .indexes import sampled
from .search import CELLS, _fit, _matrix

LANDMARKS = 2048
#: Shape of 1 / (1 + a * d ** (2 * b)) for a least distance of 0.1 at a spread of 1: fixed values of the published method.
CURVE = (1.577, 0.8951)
PLACED = "id long, x double, y double"


def strengths(near: np.ndarray) -> np.ndarray:
    """Strengths of the links of each row to its neighbours at ascending distances `near`: exp(-(d - least) / width), the width
    being such that a row's strengths sum to log2 of their number."""
    past = near - near[:, :1]
    goal, low, high = np.log2(near.shape[1]) if near.shape[1] > 1 else 1.0, np.full(len(near), 1e-9), np.full(len(near), 1e6)
    for _ in range(64):
        width = np.sqrt(low * high)
        wide = np.exp(-past / width[:, None]).sum(1) > goal
        low, high = np.where(wide, low, width), np.where(wide, width, high)
    return np.exp(-past / np.sqrt(low * high)[:, None])


def _nearest(m: np.ndarray, marks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest marks of each row by cosine, both at length 1: places and distances, ties to the smaller place."""
    at, near = np.zeros((len(m), k), np.int64), np.zeros((len(m), k))
    step = max(1, CELLS // len(marks))
    for x in range(0, len(m), step):
        far = 1 - m[x : x + step] @ marks.T
        at[x : x + step] = np.argsort(far, axis=1, kind="stable")[:, :k]
        near[x : x + step] = np.take_along_axis(far, at[x : x + step], 1)
    return at, np.maximum(near, 0)


def arranged(marks: np.ndarray, neighbours: int, rounds: int, seed: int) -> np.ndarray:
    """Places in the plane of the rows of marks (at length 1)."""
    n = len(marks)
    if n < 3:
        return np.column_stack([np.arange(n, dtype=float), np.zeros(n)])
    draw = np.random.default_rng(seed)
    k = min(neighbours, n - 1)
    at, near = _nearest(marks, marks, k + 1)
    own = at == np.arange(n)[:, None]
    own[:, -1] |= ~own.any(1)  # among many equal rows a row may not be its own neighbour
    at, near = at[~own].reshape(n, k), near[~own].reshape(n, k)
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], at] = strengths(near)
    w = w + w.T - w * w.T
    head, tail = np.nonzero(np.triu(w, 1))
    pull = w[head, tail]
    centred = marks - marks.mean(0)
    place = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    place = 10 * place / max(np.abs(place).max(), 1e-12) + 1e-4 * draw.standard_normal((n, 2))
    a, b = CURVE
    for t in range(rounds):
        gap = place[head] - place[tail]
        d = (gap * gap).sum(1)
        force = pull * (-2 * a * b * np.maximum(d, 1e-12) ** (b - 1)) / (1 + a * d**b)
        step = np.clip(force[:, None] * gap, -4, 4)
        move = np.stack([np.bincount(head, step[:, c], n) - np.bincount(tail, step[:, c], n) for c in (0, 1)], axis=1)
        for _ in range(5):
            gap = place - place[draw.permutation(n)]
            d = (gap * gap).sum(1)
            move += np.clip((2 * b / ((0.001 + d) * (1 + a * d**b)))[:, None] * gap, -4, 4)
        place = place + (1 - t / rounds) * np.clip(move, -4, 4) * 0.25
    return place


def layout(rows: DataFrame, neighbours: int = 15, rounds: int = 200, seed: int = 42, landmarks: int = LANDMARKS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, x and y of every row."""
    if neighbours < 1 or rounds < 1 or not 1 <= landmarks <= LANDMARKS:
        raise ValueError(f"neighbours and rounds must be at least 1, landmarks between 1 and {LANDMARKS}")
    unit = _fit(rows, id_col, vec_col, False).select("id", V.normalize("v").alias("v"))
    held = sampled(unit, landmarks).toArrow()
    if not held.num_rows:
        return rows.sparkSession.createDataFrame([], PLACED)
    marks = _matrix(held.column("v"))
    sent = rows.sparkSession.sparkContext.broadcast((marks, arranged(marks, neighbours, rounds, seed)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, place = sent.value
        for b in batches:
            if b.num_rows:
                at, near = _nearest(_matrix(b.column("v")), marks, min(neighbours, len(marks)))
                w = strengths(near)
                w[near[:, 0] < 1e-9, 1:] = 0  # a landmark stands where it was laid
                xy = (place[at] * w[:, :, None]).sum(1) / w.sum(1)[:, None]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["id", "x", "y"])

    return unit.mapInArrow(placed, PLACED)


def preservation(rows: DataFrame, places: DataFrame, asked: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and kept of each asked row (id): the share of its k nearest rows by cosine that are among its k nearest in the plane."""
    flat = places.select("id", F.array("x", "y").alias("v"))
    own = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    near = search.top_k(own.join(asked.select("id"), "id", "left_semi"), own, k, exclude_self=True, query_id="id", corpus_id="id", vector="v")
    seen = search.top_k(flat.join(asked.select("id"), "id", "left_semi"), flat, k, "l2", exclude_self=True, query_id="id", corpus_id="id", vector="v")
    both = near.select("query_id", "id").join(seen.select("query_id", "id", F.lit(1).alias("there")), ["query_id", "id"], "left")
    return both.groupBy(F.col("query_id").alias("id")).agg((F.count("there") / F.count("*")).alias("kept"))
