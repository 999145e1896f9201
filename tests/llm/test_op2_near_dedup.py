"""Near-duplicates against all pairs by brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import odd
import pytest

from quillon.llm import op2_near_dedup as op2


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, size):
    sets = {i: shingles(t, size) for i, t in docs}
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            p, q = root(a), root(b)
            above[max(p, q)] = min(p, q)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op2.op2_near_dedup(spark, sf)) == brute(docs, 4)


@pytest.mark.parametrize("size", [4, 5])
def test_chains_and_large_groups(spark, size):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choices(vocabulary, k=120) for _ in range(3)]
    docs = []
    for k in range(240):  # copies with a few words changed: many near ones in the same buckets
        words = list(base[k % 3])
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            words[r.randrange(120)] = r.choice(vocabulary)
        docs.append((k + 100, " ".join(words)))
    drift = list(base[0])
    for k in range(40):  # each close to the one before, far from the first
        drift[3 * k] = f"z{k}"
        docs.append((k + 1000, " ".join(drift)))
    docs += [(5000, "one two"), (5001, "One  TWO"), (5002, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(op2.near_duplicates(df, size)) == brute(docs, size)


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(1)
    shared, own = r.integers(0, 2**63, 800).astype(np.uint64), r.integers(0, 2**63, 200).astype(np.uint64)
    sig = op2.superminhash(np.concatenate([shared, shared, own]), np.array([0, 800, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = op2.near_duplicates(docs, 4).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"], r["n_shingles"] > 0): r for r in got}
    assert by[7, True]["component_id"] == 1 and not by[7, True]["kept"]
    assert by[2, False]["kept"] and by[4, False]["component_id"] == 4
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = op2.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "6", "8", "None", "None"])
    assert op2.near_duplicates(odd.documents(spark, empty=True)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """One node, linked by any of its texts."""
    r = random.Random(8)
    a, b, c = (" ".join(r.choices([f"w{k}" for k in range(400)], k=60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, b + " w1")]
    got = op2.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(1, 57, 1, True), (2, 57, 1, False), (2, 57, 1, False), (3, 57, 1, False), (4, 57, 4, True), (4, 57, 4, True), (5, 58, 1, False)]
