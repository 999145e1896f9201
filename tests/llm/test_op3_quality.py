"""Quality: accuracy on rows that were held out, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import odd
import pyarrow as pa

from quillon.llm import op3_quality as op3

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op3.op3_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert sum(got[i]["predicted"] == q for i, q in labels) / len(labels) > 0.85


def test_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (5, 0, None, "x"), (6, None, 0, "x"), (None, 1, 0, "x"), (999, 1, 0, "x"), (7, 1, 0, "x")], LABELS)
    for known in (labels, labels.limit(0)):
        got = op3.score(docs, op3.train(docs, known)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in got)
    none = odd.documents(spark, empty=True)
    assert op3.score(none, op3.train(none, labels)).count() == 0


def plain(model, text, k):
    """The vote over all neighbours, one by one and in doubles; ties go to the earlier neighbour."""
    x = op3.counts(pa.array([text or ""]))[0].astype(float)
    x = np.log1p(x) * model.idf
    z = (x / max(np.linalg.norm(x), 1e-9)) @ model.space
    z = z / max(np.linalg.norm(z), 1e-9)
    near = sorted((-round(float(z @ v), op3.DIGITS), n) for n, v in enumerate(model.vectors))[:k]
    weight = [max(-s, 1e-6) for s, _ in near]
    return sum(w * model.labels[n] for w, (_, n) in zip(weight, near, strict=True)) / sum(weight)


def test_against_a_plain_vote(spark, monkeypatch):
    """Every score against the plain vote, with groups of equal neighbours that tie for the last places, and ids that repeat."""
    docs = [(k, f"good text number {k % 5} with some words" if k % 2 else f"BAD!!! {k % 3} $$$ text", None) for k in range(60)]
    docs += [(3, "another text of the same id", None), (3, "good text number 3 with some words", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 1)) for k in range(60)], "doc_id long, quality int")
    for k in (3, 7, 200):
        monkeypatch.setattr(op3, "NEIGHBOURS", k)
        model = op3.train(frame, labels)
        assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
        for text in {t for _, t, _ in docs}:
            assert abs(model.score(op3.counts(pa.array([text])))[0] - plain(model, text, k)) < 1e-6
        got = op3.score(frame, model).collect()
        assert len(got) == len(docs)


def test_nearest_takes_the_first_of_ties():
    near = np.array([[1, 3, 2, 3, 2, 2], [5, 5, 5, 5, 5, 5], [0, 0, 1, 0, 0, 0]], np.float32)
    assert [np.flatnonzero(r).tolist() for r in op3.nearest(near, 3)] == [[1, 2, 3], [0, 1, 2], [0, 1, 2]]
    assert op3.nearest(near, 9).all()
