"""Approximate, keyword and hybrid search against exact search."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillon.operators import blocks, graphs, indexes, keywords, layouts, search
from quillon.sources import scratch
from quillon.sources.readers import table

VECTORS = "vec_id long, embedding array<double>"


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def recall(found, truth):
    truth = pairs(truth)
    return len(pairs(found) & truth) / len(truth)


@pytest.fixture(scope="module")
def vectors(spark):
    """All vectors of the table, and every tenth as a query."""
    rows = table(spark, SF, "embeddings").cache()
    return rows.where("vec_id % 10 = 0"), rows


@pytest.fixture(scope="module")
def lists(spark, vectors):
    return indexes.InvertedLists.build(vectors[1], scratch.folder(spark, "lists"), 8)


def odd_vectors(spark):
    """Nulls, zero, not finite, repeated ids, a third of all rows equal."""
    r = np.random.default_rng(3)
    rows = [(k, r.standard_normal(8).tolist()) for k in range(200)] + [(1000 + k, [1.0] + [0.0] * 7) for k in range(120)]
    rows += [(300, None), (None, [1.0] * 8), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (5, rows[5][1])]
    return spark.createDataFrame(rows, VECTORS).repartition(4)


def test_all_lists_are_exact(vectors, lists):
    for k in (1, 10, 1000):
        assert rows_of(lists.search(vectors[0], k, 8)) == rows_of(search.top_k(*vectors, k))


@pytest.mark.parametrize("metric", indexes.METRICS)
def test_metrics_and_odd_vectors(spark, metric):
    rows = odd_vectors(spark)
    own = indexes.InvertedLists.build(rows, scratch.folder(spark, "lists"), 6, metric)
    assert rows_of(own.search(rows, 5, 6)) == rows_of(search.top_k(rows, rows, 5, metric))
    assert own.sizes().agg(F.sum("n")).first()[0] == search._fit(rows, "vec_id", "embedding", metric != "cosine").count()


def test_sent_and_met_give_the_same(spark, vectors, lists, monkeypatch):
    few = rows_of(lists.search(vectors[0], 10, 3))
    monkeypatch.setattr(indexes, "ASKED", 64)
    assert rows_of(lists.search(vectors[0], 10, 3)) == few
    rows = odd_vectors(spark)
    own = indexes.InvertedLists.build(rows, scratch.folder(spark, "lists"), 6)
    assert rows_of(own.search(rows, 5, 6)) == rows_of(search.top_k(rows, rows, 5))


def test_probes_reach_their_recall(vectors, lists):
    curve = [tuple(r) for r in lists.needed(vectors[1]).orderBy("probes").collect()]
    assert [p for p, _ in curve] == sorted(p for p, _ in curve) and curve[-1][1] == 1.0
    n = lists.probes_for(vectors[1], 0.95)
    assert n == min(p for p, r in curve if r >= 0.95)
    assert recall(lists.search(vectors[0], 10, n), search.top_k(*vectors, 10)) >= 0.9
    assert recall(lists.search(vectors[0], 10, 1), search.top_k(*vectors, 10)) < 1


def test_clusters_need_one_probe(spark):
    r = np.random.default_rng(5)
    centres = 10 * r.standard_normal((6, 12))
    rows = spark.createDataFrame([(k, (centres[k % 6] + 0.1 * r.standard_normal(12)).tolist()) for k in range(300)], VECTORS)
    own = indexes.InvertedLists.build(rows, scratch.folder(spark, "lists"), 6, "l2")
    assert own.probes_for(rows, 0.99) <= 2 and sorted(x["n"] for x in own.sizes().collect())[-1] >= 50


def test_added_rows_and_filters(spark, vectors):
    rows = vectors[1]
    own = indexes.InvertedLists.build(rows.where("vec_id % 2 = 0"), scratch.folder(spark, "lists"), 8)
    own.add(rows.where("vec_id % 2 = 1"))
    again = indexes.InvertedLists(spark, own.folder)
    assert rows_of(again.search(vectors[0], 10, 8)) == rows_of(search.top_k(*vectors, 10))
    some = rows.where("label = 1").select(F.col("vec_id").alias("id"))
    assert rows_of(again.search(vectors[0], 5, 8, some)) == rows_of(search.top_k(*vectors, 5, where=F.col("label") == 1))


def test_bounds(spark, vectors, lists):
    for bad in (lambda: lists.search(vectors[0], 0), lambda: lists.search(vectors[0], 1, 0), lambda: indexes.InvertedLists.build(vectors[1], "x", 0), lambda: indexes.InvertedLists.build(vectors[1], "x", 2, "jaccard"), lambda: indexes.InvertedLists.build(vectors[1].limit(0), "x", 2), lambda: indexes.ProductCodes.build(lists, "x", 7), lambda: indexes.HyperplaneTables.build(vectors[1], "x", 1, 17)):
        with pytest.raises(ValueError):
            bad()
    assert lists.search(vectors[0].limit(0), 5, 2).count() == 0
    one = indexes.InvertedLists.build(vectors[1], scratch.folder(spark, "lists"), 1)
    assert rows_of(one.search(vectors[0], 5, 1)) == rows_of(search.top_k(*vectors, 5))


def test_product_codes(spark, vectors, lists):
    codes = indexes.ProductCodes.build(lists, scratch.folder(spark, "codes"))
    assert codes.codes().count() == vectors[1].count() and {len(r["code"]) for r in codes.codes().collect()} == {16}
    assert recall(codes.search(vectors[0], 10, 8), search.top_k(*vectors, 10)) >= 0.9
    every = codes.search(vectors[0], 10, 8, 100_000)
    assert rows_of(every) == rows_of(search.top_k(*vectors, 10))
    near = {(r["query_id"], r["id"]): r["score"] for r in search.top_k(*vectors, 1000).collect()}
    assert np.mean([abs(near[r["query_id"], r["id"]] - r["score"]) for r in codes.candidates(vectors[0], 1000, 8).collect()]) < 0.05


def test_codebooks_of_few_rows(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k), 2.0]) for k in range(9)], VECTORS)
    lists = indexes.InvertedLists.build(rows, scratch.folder(spark, "lists"), 2, "l2")
    codes = indexes.ProductCodes.build(lists, scratch.folder(spark, "codes"), 2)
    # as many codes as rows: nothing is lost
    assert rows_of(codes.candidates(rows, 9, 2)) == rows_of(search.top_k(rows, rows, 9, "l2").withColumn("score", -F.col("score") * F.col("score")))


def test_hyperplanes(spark, vectors):
    own = indexes.HyperplaneTables.build(vectors[1], scratch.folder(spark, "planes"), 8, 5)
    truth = search.top_k(*vectors, 10)
    assert own.buckets().count() == 8 * vectors[1].count()
    assert recall(own.search(vectors[0], 10, 1), truth) < recall(own.search(vectors[0], 10, 8), truth) and recall(own.search(vectors[0], 10, 8), truth) >= 0.9
    assert rows_of(own.search(vectors[0], 10, 32)) == rows_of(truth)  # all buckets


def test_hyperplanes_odd_vectors(spark, monkeypatch):
    rows = odd_vectors(spark).where("vec_id <> 5")
    own = indexes.HyperplaneTables.build(rows, scratch.folder(spark, "planes"), 3, 3)
    for asked in (1 << 21, 64):
        monkeypatch.setattr(indexes, "ASKED", asked)
        assert rows_of(own.search(rows, 5, 8)) == rows_of(search.top_k(rows, rows, 5))


def test_graph(spark, vectors):
    own = graphs.NeighbourGraph.build(vectors[1], scratch.folder(spark, "graph"), 12, 4, block=64)
    nodes = own.nodes().collect()
    assert len(nodes) == vectors[1].count() and all(len(set(n["near"])) == 12 and n["id"] not in n["near"] for n in nodes)
    assert recall(own.search(vectors[0], 10), search.top_k(*vectors, 10)) >= 0.9


def test_graph_odd_vectors(spark):
    rows = odd_vectors(spark)
    own = graphs.NeighbourGraph.build(rows, scratch.folder(spark, "graph"), 8, 3, block=64)
    assert own.nodes().count() == 320  # nulls, zeros and repeats are no nodes
    asked = rows.where("vec_id < 200").dropDuplicates(["vec_id"])
    assert recall(own.search(asked, 3), search.top_k(asked, rows.dropDuplicates(["vec_id"]), 3)) >= 0.9
    one = graphs.NeighbourGraph.build(rows.where("vec_id = 7"), scratch.folder(spark, "graph"))
    assert [r["id"] for r in one.search(rows.where("vec_id = 8"), 3).collect()] == [7]
    with pytest.raises(ValueError):
        own.search(asked, 10, 5)
    with pytest.raises(RuntimeError):
        own.search(asked, 3, hops=1)


def bm25(docs, queries, k1=1.2, b=0.75):
    held = defaultdict(Counter)
    for i, t in docs:
        if i is not None and t:
            held[i].update(re.findall(r"[^\W_]+", t.lower()))
    held = {i: c for i, c in held.items() if c}
    mean, df = sum(sum(c.values()) for c in held.values()) / len(held), Counter(w for c in held.values() for w in c)
    out = {}
    for q, t in queries:
        for i, c in held.items():
            own = [w for w in set(re.findall(r"[^\W_]+", (t or "").lower())) if w in c]
            if own:
                out[q, i] = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean)) for w in own)
    return out


def test_keywords(spark):
    docs = [(1, "The cat sat. The CAT ran!"), (2, "a dog"), (3, None), (4, ""), (5, "... !!!"), (None, "cat"), (6, "the dog and the cat"), (6, "cat again"), (7, "Étude über 42 cats")] + [(k, f"the word w{k}") for k in range(10, 60)]
    queries = [(1, "cat dog"), (2, "the the THE w12"), (3, None), (4, "nothing-here"), (5, "étude 42")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    want = bm25(docs, queries)
    for part in (1 << 16, 3):  # in one part, and with frequent words in many
        index = keywords.KeywordIndex.build(frame, scratch.folder(spark, "keywords"), part=part)
        got = {(r["query_id"], r["id"]): r["score"] for r in index.scores(asked).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in got)
    assert {r["term"]: (r["df"], r["parts"]) for r in index.terms().collect()}["the"] == (52, 18)
    top = index.search(asked, 2).where("query_id = 2").orderBy("rank").collect()
    assert top[0]["id"] == 12 and [r["rank"] for r in top] == [1, 2]
    assert pairs(index.search(asked, 50, among=spark.createDataFrame([(2,), (7,)], "id long"))) == {(1, 2), (5, 7)}
    empty = keywords.KeywordIndex.build(frame.limit(0), scratch.folder(spark, "keywords"))
    assert empty.search(asked).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, 0)


def test_keywords_sent_or_shuffled(spark, monkeypatch):
    """Both ways give the same scores; texts are shuffled once to build, and a file has all postings of its documents."""
    frame = spark.createDataFrame([(k % 40, f"the word w{k} and w{k % 7}") for k in range(60)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the w3"), (2, "w5 and w50"), (3, None)], "query_id long, text string")
    index = keywords.KeywordIndex.build(frame, scratch.folder(spark, "keywords"), part=5)
    files = index.postings().select("id", F.input_file_name().alias("f")).distinct()
    assert files.count() == 40
    one = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "id long")
    for among in (None, one):
        sent = {tuple(r) for r in index.scores(asked, among=among).select("query_id", "id", "score").collect()}
        monkeypatch.setattr(keywords, "SENT", 0)
        shuffled = {tuple(r) for r in index.scores(asked, among=among).select("query_id", "id", "score").collect()}
        monkeypatch.undo()
        assert sent == shuffled and sent
    plan = keywords.postings(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keywords_for_many_queries(spark, monkeypatch):
    """Blocks of few words, documents and queries give what the index gives: repeated ids, ties, null and wordless texts, frequent and rare words."""
    r = np.random.default_rng(3)
    texts = [(k % 170, " ".join(f"w{int(x)}" for x in r.zipf(1.4, int(r.integers(1, 60))) if x < 500)) for k in range(200)]
    frame = spark.createDataFrame([*texts, (900, None), (901, "..."), (None, "w1"), (902, "w3 w3"), (903, "w3 W3"), (904, " ".join(["w1 w2 w3"] * 200))], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(k, texts[k * 2][1]) for k in range(60)] + [(70, None), (71, "!"), (72, "nowhere"), (73, "w3"), (74, "w4 w3")], "query_id long, text string")
    index = keywords.KeywordIndex.build(frame, scratch.folder(spark, "keywords"))
    for name, x in {"BLOCK": 300, "DOCS": 16, "QUERIES": 10, "DENSE": 8, "CELLS": 50}.items():
        monkeypatch.setattr(keywords, name, x)
    for k in (4, 1000):
        want, got = ({tuple(x) for x in df.collect()} for df in (index.search(asked, k), keywords.search_many(frame, asked, k)))
        assert want == got and len(got) > 4 * 60 - 1
    blocks = keywords.packed(frame).collect()
    assert len(blocks) > 10 and sum(len(b["ids"]) // 8 for b in blocks) == frame.where("text rlike '[a-z]' AND doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert keywords.search_many(frame.limit(0), asked).count() == keywords.search_many(frame, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        keywords.search_many(frame, asked, 0)


def test_hybrid_writes_no_pairs(spark, tmp_path):
    """100 queries and 2,000 documents that all share a word: no stage gives out their 200,000 pairs."""
    spark.range(2000).selectExpr("id AS doc_id", "concat('the w', id % 50) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = (got := keywords.search_many(frame, frame.where("doc_id % 20 = 0"), 5, query_id="doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan and "Generate" not in plan
    assert got.count() == 500


def test_fused(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 7, 2), (1, 6, 3)], "query_id long, id long, rank int")
    got = [tuple(r)[:3] for r in keywords.fused([a, b], 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 7), (1, 2, 8), (2, 1, 9)]  # a tie goes to the smaller id
    assert [r["id"] for r in keywords.fused([a, b], 1, weights=[1.0, 3.0]).orderBy("query_id").collect()] == [8, 9]
    with pytest.raises(ValueError):
        keywords.fused([])


def test_expanded(spark, vectors):
    queries, rows = vectors
    m = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in rows.collect()}
    ids = np.array(sorted(m))
    every = np.stack([m[i] for i in ids])
    for r in search.expanded(queries, rows, 4, 3, 2).collect():
        v = m[r["query_id"]]
        for _ in range(2):
            order = np.lexsort((ids, -(every @ v)))
            v = v + 0.75 * every[order[:4]].mean(0) - 0.15 * every[order[4:7]].mean(0)
            v = v / np.linalg.norm(v)
        assert np.allclose(r["v"], v, atol=1e-9)
    lone = search.expanded(queries, rows.limit(0), 4)
    assert lone.count() == queries.count()
    with pytest.raises(ValueError):
        search.expanded(queries, rows, 0)


def test_layout_keeps_clusters_together(spark):
    """Eight clusters in 24 dimensions, more rows than landmarks: neighbours in the plane are of the same cluster."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((8, 24))
    rows = spark.createDataFrame([(k, (centres[k % 8] + 0.15 * r.standard_normal(24)).tolist()) for k in range(800)], VECTORS).cache()
    places = layouts.layout(rows, landmarks=300).cache()
    assert places.count() == 800 and sorted(map(tuple, places.collect())) == sorted(map(tuple, layouts.layout(rows, landmarks=300).collect()))
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"))
    flat = places.select("id", F.array("x", "y").alias("v"))
    near = search.top_k(flat.join(asked, "id"), flat, 10, "l2", exclude_self=True, query_id="id", corpus_id="id", vector="v")
    assert near.agg(F.avg((F.col("query_id") % 8 == F.col("id") % 8).cast("double"))).first()[0] > 0.98


def test_layout_keeps_neighbours(spark):
    """A sheet bent through 24 dimensions: most of the ten nearest rows stay near, and more of them than in two plain directions."""
    r = np.random.default_rng(11)
    sheet, waves, shift = r.random((800, 2)), 2 * r.standard_normal((2, 24)), 6.28 * r.random(24)
    m = np.cos(sheet @ waves + shift)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], VECTORS).cache()
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"))
    cut = rows.select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    kept = [layouts.preservation(rows, p, asked).agg(F.avg("kept")).first()[0] for p in (layouts.layout(rows, landmarks=400), cut)]
    assert kept[0] > 0.5 and kept[0] > kept[1], kept


def test_layout_odd_vectors(spark):
    rows = odd_vectors(spark)
    places = layouts.layout(rows, landmarks=100).collect()
    assert len(places) == 321 and all(math.isfinite(p["x"]) and math.isfinite(p["y"]) for p in places)
    assert len({(round(p["x"], 9), round(p["y"], 9)) for p in places if p["id"] and p["id"] >= 1000}) <= 100
    assert layouts.layout(rows.limit(0)).count() == 0 and layouts.layout(rows.where("vec_id < 2")).count() == 2
    with pytest.raises(ValueError):
        layouts.layout(rows, 0)


def test_strengths():
    near = np.sort(np.random.default_rng(2).random((50, 15)), axis=1)
    w = layouts.strengths(near)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-6) and (np.diff(w, axis=1) <= 0).all() and (w[:, 0] == 1).all()


def test_wide_vectors_make_small_blocks(spark, vectors, monkeypatch):
    few = rows_of(search.top_k(*vectors, 5))
    assert blocks._sized(vectors[1].select("embedding"), 1 << 16)[1] == 1 << 16
    monkeypatch.setattr(blocks, "BYTES", 64 * 8 * 40)  # forty vectors
    assert blocks._sized(vectors[1].select("embedding"), 1 << 16) == (vectors[1].count(), 40)
    assert rows_of(search.top_k(*vectors, 5)) == few
