"""Semantics of single functions and operators on small rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import captions, rules
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import agents, cache, control, encoders, quality, ranking, records, search, telemetry


def one(spark, column, row=(1,), schema="x int"):
    return spark.createDataFrame([row], schema).select(column.alias("y")).first()["y"]


def vec(spark, column, v):
    return one(spark, column, (v,), "v array<double>")


def test_normalize_conventions(spark):
    assert vec(spark, V.normalize("v"), [3.0, 4.0]) == [0.6, 0.8]
    assert vec(spark, V.normalize("v"), [0.0, 0.0]) == [0.0, 0.0]
    assert vec(spark, V.normalize("v", "null"), [0.0, 0.0]) is None
    assert vec(spark, V.normalize("v", "eps"), [0.0, 0.0]) == [0.0, 0.0]
    assert vec(spark, V.normalize_if_large("v"), [3.0, 4.0]) == [3.0, 4.0]
    assert vec(spark, V.normalize_if_large("v"), [30.0, 40.0]) == [0.6, 0.8]


def test_cosine_of_zero_and_odd_lengths(spark):
    assert vec(spark, V.cosine("v", F.array(F.lit(0.0), F.lit(0.0))), [1.0, 2.0]) is None
    assert vec(spark, V.cosine("v", F.array(F.lit(1.0))), [1.0, 2.0]) is None
    assert vec(spark, V.is_finite("v"), [1.0, math.nan]) is False
    assert vec(spark, V.clip(F.get("v", F.lit(0))), [1.5]) == 1.0


def test_resize(spark):
    assert vec(spark, V.upsample("v", 2, 5), [1.0, 2.0]) == [1.0, 1.0, 2.0, 2.0, 1.0]
    assert vec(spark, V.downsample("v", 4, 2), [1.0, 2.0, 3.0, 4.0]) == [2.0, 3.0]
    with pytest.raises(ValueError):
        V.downsample("v", 5, 2)


def test_histogram_and_entropy(spark):
    v = [float(k) for k in range(11)]
    assert vec(spark, V.histogram("v"), v) == [1] * 9 + [2]
    assert vec(spark, V.entropy("v"), [1.0, 1.0]) == 0.0
    assert vec(spark, V.std("v"), [1.0, 3.0]) == 1.0
    assert vec(spark, V.std("v", sample=True), [1.0]) is None
    assert vec(spark, rules.category("v", with_entropy=False), [0.5, 1.5]) == "nature"


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.title(F.lit("foo_bar baz")), "Foo_Bar Baz"),
        (lambda: T.tasks(F.lit("All Tasks")), T.ALL_TASKS),
        (lambda: T.tasks(F.lit("Browsing, Contact Search, foo_bar")), ["browsing", "contact_search", "foo_bar"]),
        (lambda: T.answer_after(F.lit("Q: why? because "), F.lit("why?")), "because"),
        (lambda: T.answer_after(F.lit(" none "), F.lit("why?")), "none"),
        (lambda: T.listed(F.lit("['a', 'b']")), ["a", "b"]),
        (lambda: T.listed(F.lit("plain")), ["plain"]),
        (lambda: T.shorten(F.lit("abcdef"), 3), "abc..."),
        (lambda: T.is_error(F.lit("Error: x")), True),
        (lambda: T.is_error(F.lit("No image available for processing"), False), False),
        (lambda: T.is_error(F.lit(None).cast("string")), False),
        (lambda: T.strip_namespace(F.lit("ns:ns:k"), "ns:"), "ns:k"),
        (lambda: T.numbers_after(F.lit("rate: 1.5 x rate: 2"), "rate"), [1.5, 2.0]),
    ],
)
def test_text(spark, column, want):
    assert one(spark, column()) == want


def test_long_key_is_hashed(spark):
    assert one(spark, T.cache_key(F.lit("k" * 101), "n:")).startswith("n:") and len(one(spark, T.cache_key(F.lit("k" * 101), "n:"))) == 34
    assert one(spark, T.cache_key(F.lit("k" * 100), "n:")) == "n:" + "k" * 100


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [math.nan, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_search_ties_zero_null_and_large_k(spark, points):
    got = [(r["query_id"], r["rank"], r["id"]) for r in search.top_k(points.where("vec_id = 1"), points, 10).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert search.top_k(points.where("vec_id = 4"), points, 3).count() == 0
    assert search.top_k(points.where("vec_id > 100"), points, 3).count() == 0
    assert search.top_k(points.where("vec_id = 1"), points.limit(0), 3).count() == 0


def test_search_checks_its_arguments(points):
    for bad in ({"k": 0}, {"threshold": 2.0}, {"metric": "hamming"}):
        with pytest.raises(ValueError):
            search.top_k(points, points, **{"k": 3, **bad})


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(60) for i in np.argsort(-(unit @ unit[q]), kind="stable")[:4]}
    assert {(r["query_id"], r["id"]) for r in search.top_k(df, df, 4).collect()} == want


def test_diagonal_wins(spark):
    v = [(k, [1.0 if j == k else 0.1 for j in range(4)]) for k in range(4)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    assert {r["metric"]: r["value"] for r in ranking.suite(ranking.ranks(df, df)).collect()} == {"recall@1": 1.0, "recall@5": 1.0, "recall@10": 1.0, "mrr": 1.0, "ndcg@5": 1.0}


def test_multi_truth(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12)], "query_id long, id long")
    got = ranking.multi_truth(found, truth, (1, 2, 50), size=20).first()
    assert (got["recall_1"], got["recall_2"], got["recall_50"], got["mrr"]) == (0.0, 0.5, None, 0.25)


def test_label_truth(spark, monkeypatch):
    """Ranks of all items of a label as true_ranks gives them, in blocks of few items and queries: ties, zero and null vectors, null labels."""
    r = np.random.default_rng(8)
    v = r.integers(-2, 3, (300, 3)).astype(float).tolist()
    rows = [(k, None if k % 41 == 5 else x if k % 37 else [0.0, 0.0, 0.0], None if k % 29 == 0 else int(r.integers(0, 4))) for k, x in enumerate(v)] + [(300, v[7], 9)]
    items = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    asked = items.where("id % 10 IN (0, 5)")
    truth = asked.select(F.col("id").alias("query_id"), "label").join(items, "label").where("id <> query_id").select("query_id", "id")
    want = {x[0]: x[1:] for x in ranking.multi_truth(ranking.true_ranks(asked.select("id", "v"), truth, items.select("id", "v")), truth).collect()}
    for held, block in ((ranking.HELD, ranking.ITEMS), (700, 7)):
        monkeypatch.setattr(ranking, "HELD", held)
        monkeypatch.setattr(ranking, "ITEMS", block)
        got = ranking.label_truth(asked, items)
        rows_ = {x["query_id"]: x[1:] for x in got.collect()}
        assert set(rows_) == set(want) and all(np.allclose(rows_[q], want[q], atol=1e-12) for q in want) and 300 not in rows_
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "CoGroup" not in plan and "Generate" not in plan
    assert ranking.label_truth(asked.limit(0), items).count() == ranking.label_truth(asked, items.limit(0)).count() == 0
    twice = ranking.label_truth(asked, items.union(items.where("id = 1"))).where("query_id = 10").count()
    assert twice == 1


def test_multi_truth_makes_no_pairs(spark, monkeypatch, tmp_path):
    """The query takes no join of queries and items by label."""
    from quillon.plans import retrieval

    spark.range(400).selectExpr("id AS vec_id", "array(float(id % 7), 1f) AS embedding", "int(id % 2) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(ranking, "true_ranks", None)
    assert retrieval.retrieval_multi_truth(spark, str(tmp_path)).count() == 4


def test_rerank_puts_unscored_last(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, id long, rank int")
    scores = spark.createDataFrame([(1, 12, -5.0)], "query_id long, id long, score double")
    assert [r["id"] for r in search.rerank(found, scores).orderBy("rank").collect()] == [12, 10, 11]


def test_combine_passes_one_side_through(spark):
    t = spark.createDataFrame([(1, [1.0, 1.0])], "t long, v array<double>")
    none = spark.createDataFrame([], "i long, v array<double>")
    assert search.combine(t, none).first()["v"] == [1.0, 1.0]


def test_combine_blocks(spark):
    """More rows than a block on both sides, a zero mean and a null vector: every pair once."""
    r = np.random.default_rng(6)
    t, i = r.standard_normal((150, 3)), r.standard_normal((1100, 3))
    i[7] = -t[3]
    texts = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(t)] + [(999, None)], "t long, v array<double>")
    images = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(i)], "i long, v array<double>")
    got = {(x["t"], x["i"]): x["v"] for x in search.combine(texts, images).where("t % 50 = 3").collect()}
    assert len(got) == 3 * 1100 and got[3, 7] == [0.0, 0.0, 0.0]
    for (a, b), v in got.items():
        m = (t[a] + i[b]) / 2
        assert np.allclose(v, m / (np.linalg.norm(m) or 1))


def test_combine_sends_no_row_twice(spark):
    """However many blocks the sides have, nothing is repeated below a shuffle."""
    texts = spark.range(150).selectExpr("id AS t", "array(double(id), 1.0) AS v")
    images = spark.range(1100).selectExpr("id AS i", "array(1.0, double(id)) AS v")
    got = search.combine(texts, images)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan and "Broadcast" not in plan
    assert got.select("t", "i").distinct().count() == got.count() == 150 * 1100


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], "a string")
    assert quality.text_stats(empty, ["a"]).count() == 0
    got = telemetry.summary(spark.createDataFrame([], "batch_size int, processing_time double")).first()
    assert (got["batches"], got["samples"], got["throughput"]) == (0, 0, 0.0)
    assert telemetry.best_batch_size(spark.createDataFrame([], "batch_size int, processing_time double")).first()["batch_size"] == 16
    few = spark.createDataFrame([(4, 1.0), (8, 9.0)], "batch_size int, processing_time double")
    assert telemetry.best_batch_size(few).first()["batch_size"] == 8


def test_cache_life(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([("a", [1.0]), ("b", None)], "k string, v array<double>")
    held = cache.entries(rows, "k", "v", now, "n:")
    assert [r["key"] for r in held.collect()] == ["n:a"]
    assert cache.alive(held, F.lit("2024-01-01 12:00:00").cast("timestamp")).count() == 1
    assert cache.alive(held, F.lit("2024-01-02 12:00:00").cast("timestamp")).count() == 0
    assert cache.flush(held, "n:").count() == 0
    lookups = spark.createDataFrame([(True,)] * 50 + [(False,)] * 10, "hit boolean")
    assert round(cache.stats(lookups).first()["hit_rate"], 4) == 0.8333


def test_records(spark):
    a = spark.createDataFrame([(1, "x")], "id long, img string")
    assert records.first_present(a, records.IMAGE_NAMES) == "img"
    assert [r["c"] for r in a.select(records.caption(a).alias("c")).collect()] == ["Unknown"]
    with pytest.raises(ValueError):
        records.require(a, ["id", "none"])
    assert records.concatenated([a, a.drop("img")]).count() == 2
    log = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "id long, at int, v string")
    assert {(r["id"], r["v"]) for r in records.latest(log, ["id"], ["at"]).collect()} == {(1, "new"), (2, "only")}
    assert [r["id"] for r in records.ids(spark.range(50).withColumnRenamed("id", "k").repartition(7), ["k"]).orderBy("k").collect()] == list(range(50))
    assert [r["line"] for r in records.markdown(a, ["id"]).orderBy("line_no").collect()] == ["| id | img |", "| --- | --- |", "| 1 | x |"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_of_many_rows(spark, adaptive):
    """Three million rows, with columns besides the key: every id once, in the order of the key."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 3_000_000
        rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").alias("other"), F.md5(F.col("id").cast("string")).alias("text")).repartition(16)
        got = records.ids(rows, ["k"])
        assert tuple(got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()) == (n, n, 0, n - 1)
        # along the ids the keys rise: the id is the number of smaller keys
        part = got.where("id % 100000 = 0").select("id", "k").orderBy("id").collect()
        assert [r["k"] for r in part] == sorted(r["k"] for r in part) and len(part) == 30
        assert got.where(F.col("text") != F.md5(F.col("other").cast("string"))).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_plan_defaults(spark):
    tasks = agents.parsed(spark.createDataFrame([(1, "Browsing, foo bar")], "id int, request string"), "id", "request")
    known = spark.createDataFrame([("browsing", "Browse", "msg", "2 days ago")], "task string, title string, last_commit_message string, last_commit_date string")
    got = [(r["task"], r["title"], r["last_commit_date"]) for r in agents.planned(tasks, known).orderBy("place").collect()]
    assert got == [("browsing", "Browse", "2 days ago"), ("foo_bar", "Foo_Bar", "N/A")]
    assert agents.report(agents.executed(agents.planned(tasks, known)), "id").first()["report"].count("\n") == 1


#: By rule: batches of one stream as (size, seconds, share of memory, seconds since the batch before), and the sizes advised, by hand.
ADVICE = {
    "throughput": ([(10, 1.0, 0.8, 1), (10, 1.0, 0.5, 1), (10, 4.0, 0.65, 1), (10, 1.0, 0.65, 1), (64, 1.0, 0.1, 1)], [8, 14, 3, 12, 64]),
    "steady": ([(10, 1.5, 0.8, 1), (10, 1.5, 0.5, 1), (10, 4.0, 0.65, 1), (10, 1.2, 0.65, 1), (20, 1.5, 0.65, 1), (5, 1.5, 0.65, 1)], [7, 12, 4, 12, 21, 4]),
    "warm_up": ([(10, 0.1, 0.1, 1), (10, 0.1, 0.1, 1), (10, 0.1, 0.1, 1), (20, 0.1, 0.55, 1), (10, 3.0, 0.1, 1), (10, 1.0, 0.1, 1), (4, 0.1, 0.55, 1)], [10, 10, 12, 24, 8, 10, 4]),
    "one_step": ([(10, 1.0, 0.9, 1), (10, 1.0, 0.1, 1), (10, 6.0, 0.1, 1), (1, 1.0, 0.9, 1)], [9, 11, 10, 1]),
    "per_sample": ([(10, 0.05, 0.1, 1), (10, 0.05, 0.1, 5), (10, 0.05, 0.1, 11), (10, 2.0, 0.1, 11), (9, 2.0, 0.1, 11), (8, 2.0, 0.1, 11)], [12, 10, 12, 8, 8, 8]),
    "gap": ([(40, 0.3, 0.3, 1), (40, 0.3, 0.3, 4), (40, 1.0, 0.3, 6), (40, 0.3, 1.0, 6)], [50, 40, 36, 36]),
}


@pytest.mark.parametrize("rule", sorted(control.RULES))
def test_advised_sizes(spark, rule):
    batches, want = ADVICE[rule]
    rows, at = [], 0
    for k, (size, seconds, memory, pause) in enumerate(batches):
        at += pause
        rows += [(u, at, k, size, seconds, memory, min(1.0, seconds) * 100, 1000) for u in (1, 2)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, batch_size int, processing_time double, memory double, cpu double, room int").repartition(3)
    got = {(r["user_id"], r["event_id"]): r["advice"] for r in control.advised(df, "user_id", rule).collect()}
    assert [[got[u, k] for k in range(len(want))] for u in (1, 2)] == [want, want]


def test_best_mean(spark):
    rows = [(1, k, k, [8, 16][k % 2], [0.5, 2.0][k % 2]) for k in range(6)] + [(2, k, k, 10 + k, 1.0) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, batch_size int, processing_time double")
    assert {(r["user_id"], r["advice"]) for r in control.best_mean(df, "user_id").collect()} == {(1, 8), (2, 12)}


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in encoders.encode(docs, "id", "text").collect()}
    assert got[1] == got[3] and not any(got[2]) and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    pairs = spark.createDataFrame([("a b", "b c")], "l string, r string")
    assert round(encoders.score_pairs(pairs, "l", "r", encoders.overlap_scorer).first()["score"], 4) == 0.3333
    encoders.register("other", encoders.hashing_encoder)
    assert "other" in encoders.models()
    encoders.unregister("other")


def test_components_of_vectors(spark):
    rows = [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]
    got = encoders.projected(spark.createDataFrame(rows, "id long, v array<double>"), "v", 1).first()
    assert len(got["components"]) == 1


def test_mixed_scores_rank_all_candidates(spark):
    """The best of the mixture stands in neither list of one: it is second by cosine and second by dot."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.5]), (3, [2.5, 12.0])], "vec_id long, embedding array<double>")
    got = search.top_k(rows.where("vec_id = 1"), rows, 1, "mixed", weight=0.7).collect()
    assert [search.top_k(rows.where("vec_id = 1"), rows, 1, m).first()["id"] for m in ("cosine", "dot")] == [1, 3]
    assert [(r["id"], r["rank"]) for r in got] == [(2, 1)] and abs(got[0]["score"] - (0.7 * 2 / 4.25**0.5 + 0.3 * 2)) < 1e-9


def test_label_means(spark):
    r = np.random.default_rng(1)
    rows = [(int(k % 3), r.standard_normal(5).tolist()) for k in range(40)] + [(7, [1.0] * 5), (8, [0.0] * 5), (8, [1.0] * 5), (8, [1.0] * 5), (9, None)]
    got = {x["label"]: (x["n_pairs"], x["mean"]) for x in ranking.label_means(spark.createDataFrame(rows, "label int, v array<double>"), "label", "v").collect()}
    for label in (0, 1, 2):
        m = np.array([v for k, v in rows if k == label])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        assert got[label][0] == len(m) * (len(m) - 1) // 2 and abs(got[label][1] - (m @ m.T)[np.triu_indices(len(m), 1)].mean()) < 1e-9
    assert got[7] == (0, None) and got[8][0] == 1 and abs(got[8][1] - 1) < 1e-9 and 9 not in got


def test_captions(spark):
    rows = spark.createDataFrame([(1, [30.0, -1.0, 2.0], "describe"), (2, [0.1] * 4, None), (3, None, "x"), (4, [1.0], "x"), (5, [], "x")], "id long, v array<double>, p string")
    got = {x["id"]: x["c"] for x in rows.select("id", captions.caption(F.col("id"), "v", F.col("p")).alias("c")).collect()}
    assert got[1].endswith(" The visual content appears to have intricate and energetic qualities.")  # at length 1
    assert got[2].split(" Analysis reveals ")[0] in captions.TEMPLATES["person"] and "subtle, colorful, and organized" in got[2]
    assert got[3] is None and got[4] is None and got[5] is None


def test_ranks_against_a_plain_count(spark, monkeypatch):
    """Copies tie, ids of the items repeat, a vector is zero; pairs of a query and its true items carry no vectors, so few blocks hold them."""
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 6))
    rows = [(k, (base[k % 30] if k % 9 else base[0] * 0).tolist()) for k in range(60)]
    monkeypatch.setattr(ranking, "ROWS", 7)
    monkeypatch.setattr(ranking, "ITEMS", 11)
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in rows}
    s = {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit}
    better = lambda a, t, b: s[a, b] > s[a, t] + 1e-12 or (abs(s[a, b] - s[a, t]) <= 1e-12 and b < t)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {x["query_id"]: x["rank"] for x in ranking.ranks(df, df).collect()} == {a: 1 + sum(better(a, a, b) for b in unit if b != a) for a in unit}
    truth = [(a, b) for a in range(0, 60, 4) for b in range(60) if a != b and a % 3 == b % 3]
    seen = []
    real = ranking.met
    monkeypatch.setattr(ranking, "met", lambda left, *rest, **more: seen.append((left.where("v IS NOT NULL").count(), left.columns)) or real(left, *rest, **more))
    got = ranking.true_ranks(df.where("id % 4 = 0"), spark.createDataFrame(truth, "query_id long, id long"), df).collect()
    assert {(x["query_id"], x["id"]): x["rank"] for x in got} == {(a, t): 1 + sum(better(a, t, b) for b in unit if b not in (a, t)) for a, t in truth}
    assert seen == [(15, ["id", "true_id", "truth", "v"])]
