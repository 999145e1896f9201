"""Exact top-k: against SQL on the table, and against brute force on odd rows and with small pages."""

from __future__ import annotations

import math

import numpy as np
import pytest
from compare import connection, difference

from quillon.llm import op10_topk as op10


def brute(rows, queries, k):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in fine if i in queries}:  # the best of all pairs, if an id stands in several rows
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for n, q in fine if n == i for j, v in fine if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def test_table(spark, sf):
    assert not difference(op10.op10_topk(spark, sf), connection(sf), op10.ORACLE)


@pytest.mark.parametrize("directory", [1 << 15, 0])
def test_ties_pages_and_repeated_ids(spark, monkeypatch, directory):
    monkeypatch.setattr(op10, "PAGE", 100)
    monkeypatch.setattr(op10, "QUERIES", 3)
    monkeypatch.setattr(op10, "DIRECTORY", directory)
    r = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in r.integers(-3, 4, 6) / 8]) for k in range(700)]
    rows += [(50, [0.5, 0.5, -0.5, 1.0, 0.0, 0.25]), (50, rows[50][1]), (77, [1.0] * 6), (77, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(x) for x in op10.top_k(df, df.where("vec_id % 50 = 0"), 7).collect())
    assert got == sorted(brute(rows, set(range(0, 700, 50)), 7))


def test_bounds_avoid_products():
    """On clustered vectors most products are never computed, in any dimension; the results are those of brute force."""
    r = np.random.default_rng(3)
    for dim in (8, 64):
        centers = r.normal(size=(40, dim))
        v = np.floor(256 * (centers[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, dim))))
        ids, q = np.arange(4000), v[::50]
        tree = op10.MTree(ids, v)
        scores, found = tree.search(ids[::50], q, 5, np.full(len(q), -np.inf))
        plain = q @ v.T
        plain[np.arange(len(q)), ids[::50]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, plain.shape), -plain), axis=1)[:, :5]
        assert (found == order).all() and (scores == np.take_along_axis(plain, order, 1)).all()
        assert tree.computed < 0.5 * plain.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.001, 1.0]), (100, [1.0, 2.0, 3.0]), (150, None)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {tuple(x) for x in op10.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, {0, 50, 100, 150}, 5)
    none = df.limit(0)
    assert op10.top_k(none, none).count() == 0 and op10.top_k(df, none).count() == 0
