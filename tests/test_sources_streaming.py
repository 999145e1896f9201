"""Readers, writers and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import agents, encoders, search, telemetry
from quillon.sources import readers, writers
from quillon.sources.readers import table
from quillon.streaming import streams


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    for kind in ("parquet", "json", "csv", "orc"):
        path = f"{tmp_path}/x.{kind}"
        writers.snapshot(df, path, kind)
        got = (spark.read.json(path) if kind == "json" else readers.records(spark, path)).select("id", "t")
        assert {(int(r["id"]), r["t"]) for r in got.collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        readers.records(spark, "x.pickle")
    writers.lines(df, "t", f"{tmp_path}/x.txt")
    assert readers.records(spark, f"{tmp_path}/x.txt").count() == 2


def test_named_sources(spark, tmp_path, sf):
    got = readers.named_sources(spark, {"good": f"{sf}/region.parquet", "bad": f"{tmp_path}/none"})
    assert {r["source_name"] for r in got.select("source_name").distinct().collect()} == {"good"}
    with pytest.raises(ValueError):
        readers.named_sources(spark, {"bad": f"{tmp_path}/none"})
    assert readers.with_retries(lambda: table(spark, sf, "region"), 2, 0.0).count() == 5
    assert readers.first_readable(lambda: spark.read.parquet(f"{tmp_path}/none"), lambda: table(spark, sf, "region")).count() == 5


def test_files(spark, tmp_path):
    np.save(tmp_path / "a_vector.npy", np.array([1.0, 2.0], np.float32))
    (tmp_path / "b.bin").write_bytes(np.array([3.0], "<f4").tobytes())
    found = readers.files(spark, str(tmp_path), ("npy", ".bin"))
    assert {r["caption"] for r in found.collect()} == {"a vector", "b"}
    assert sorted(r["embedding"] for r in readers.float_vectors(found).collect()) == [[1.0, 2.0], [3.0]]
    (tmp_path / "p.txt").write_text("# no\n\nDescribe it\n")
    assert [r["prompt"] for r in readers.prompts(spark, f"{tmp_path}/p.txt").collect()] == ["Describe it"]


def test_report(spark):
    text = "Head\nQuery: a cat\n  1. cat.jpg (Score: 0.91) [MATCH]\n  2. dog.jpg (Score: -0.10)\nQuery: a dog\n  1. dog.jpg (Score: 0.80) [MATCH]\n"
    got = readers.report_blocks(spark.createDataFrame([(1, text)], "id int, value string"), "id")
    assert {(r["query"], r["rank"], r["item"], r["score"], r["is_match"]) for r in got.collect()} == {("a cat", 1, "cat.jpg", 0.91, True), ("a cat", 2, "dog.jpg", -0.1, False), ("a dog", 1, "dog.jpg", 0.8, True)}


def test_collection(spark, tmp_path):
    c = writers.Collection(spark, f"{tmp_path}/c", {"v": 2})
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0], 1), (3, None, 1)], "id long, v array<double>, at int")
    assert not c.exists()
    c.create(rows)
    assert {r["id"] for r in c.read().collect()} == {1, 3}
    c.upsert(spark.createDataFrame([(1, [0.0, 1.0], 2), (1, [5.0, 5.0], 1), (4, [1.0, 1.0], 1)], rows.schema), ["at"])
    assert {(r["id"], tuple(r["v"] or ())) for r in c.read().collect()} == {(1, (0.0, 1.0)), (3, ()), (4, (1.0, 1.0))}
    c.delete(spark.createDataFrame([(4,)], "id long"))
    assert {r["id"] for r in c.read().collect()} == {1, 3}


def test_collection_finds_its_widths(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, [1.0, 2.0, 3.0], "a"), (2, [1.0, 0.0], [1.0, 2.0], "b"), (3, [2.0, 0.0], None, "c")], "id long, v array<double>, w array<float>, t string").coalesce(1)
    c = writers.Collection(spark, f"{tmp_path}/c")
    c.create(rows)
    assert c.vectors == {"v": 2, "w": 3} and {r["id"] for r in c.read().collect()} == {1, 3}
    again = writers.Collection(spark, f"{tmp_path}/c")
    again.upsert(spark.createDataFrame([(4, [1.0], [1.0, 2.0, 3.0], "d"), (5, [1.0, 1.0], [1.0, 2.0, 3.0], "e")], rows.schema), ["t"])
    assert again.vectors == {"v": 2, "w": 3} and {r["id"] for r in again.read().collect()} == {1, 3, 5}
    assert writers.widths(rows.select("id", "t")) == {} and writers.widths(rows.limit(0)) == {}


def test_synthetic(spark):
    a, b = readers.synthetic(spark, 5, 8), readers.synthetic(spark, 5, 8)
    assert a.collect() == b.collect() and abs(sum(x * x for x in a.first()["embedding"]) - 1) < 1e-9


@pytest.fixture
def events(spark, sf, tmp_path):
    rows = table(spark, sf, "events").where("event_id < 300")
    rows.repartition(3).write.parquet(f"{tmp_path}/events")
    return rows, streams.files(spark, f"{tmp_path}/events", rows.schema)


def test_tumbling_stream_equals_batch(spark, events, tmp_path):
    rows, stream = events
    held = []
    streams.each_batch(streams.tumbling(stream, "1 hour", "365 days", "event_type"), lambda b, n: held.append([tuple(r)[:3] for r in b.collect()]), f"{tmp_path}/c", "complete")
    want = {(r["start"], r["event_type"], r["n"]) for r in telemetry.tumbling(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event_type").collect()}
    assert set(held[-1]) == want


def test_session_and_sliding_streams(spark, events, tmp_path):
    rows, stream = events
    streams.drained(streams.sessions(stream, "30 minutes", "0 seconds", "user_id"), f"{tmp_path}/s", f"{tmp_path}/sc")
    assert 0 < spark.read.parquet(f"{tmp_path}/s").count() <= rows.count()
    held = []
    streams.each_batch(streams.sliding(stream, "1 hour", "30 minutes", "365 days"), lambda b, n: held.append(b.agg(F.sum("n")).first()[0]), f"{tmp_path}/wc", "complete")
    assert held[-1] == 2 * rows.count()


def test_latest_status_stream(spark, events, tmp_path):
    rows, stream = events
    keyed = stream.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("status"))
    seen: dict[int, str] = {}
    streams.each_batch(streams.latest_status(keyed), lambda b, n: seen.update({r["key"]: r["status"] for r in b.collect()}), f"{tmp_path}/c", "update", limit=300)
    assert seen == {r["user_id"]: r["status"] for r in agents.latest_status(rows, "user_id", "event_type", "ts", "event_id").collect()}


def test_expiring_stream(spark, events, tmp_path):
    rows, stream = events
    total = [0, 0]

    def add(b, n):
        r = b.agg(F.sum("hits"), F.sum("lookups")).first()
        total[0] += r[0] or 0
        total[1] += r[1] or 0

    streams.each_batch(streams.expiring(stream.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"))), add, f"{tmp_path}/c", "update", idle=False, limit=300)
    assert total == [rows.count() - rows.select("user_id").distinct().count(), rows.count()]


def test_read_through_stream(spark, events, tmp_path):
    rows, stream = events
    keys = stream.select(F.col("user_id").cast("string").alias("key"))
    streams.read_through(spark, keys, f"{tmp_path}/cache", lambda k: k.select("key", F.array(F.lit(1.0)).alias("embedding")), f"{tmp_path}/c")
    held = spark.read.parquet(f"{tmp_path}/cache")
    assert held.count() == held.select("key").distinct().count() == rows.select("user_id").distinct().count()


def test_deduplicated_and_transcripts(spark, sf, tmp_path, events):
    _, stream = events
    streams.drained(streams.deduplicated(stream, "user_id", "365 days"), f"{tmp_path}/d", f"{tmp_path}/dc")
    held = spark.read.parquet(f"{tmp_path}/d")
    assert held.count() == held.select("user_id").distinct().count()
    talk = table(spark, sf, "conversations")
    talk.write.parquet(f"{tmp_path}/talk")
    seen: dict[int, str] = {}
    source = streams.files(spark, f"{tmp_path}/talk", talk.schema).select(F.col("conv_id").alias("key"), "turn", "role", "text")
    streams.each_batch(streams.transcripts(source), lambda b, n: seen.update({r["key"]: r["transcript"] for r in b.collect()}), f"{tmp_path}/tc", "update")
    assert seen == {r["conv_id"]: r["transcript"] for r in agents.transcript(talk).collect()}


def test_listing_and_arrays(spark, tmp_path):
    for name in ("b", "a"):
        np.savez(tmp_path / f"{name}.npz", x=np.ones((2, 2), np.float32), y=np.zeros(3, np.float32))
    found = readers.listing(readers.files(spark, str(tmp_path), ("npz",)), 1)
    assert [r["name"] for r in found.collect()] == ["a.npz"]
    got = {r["path"].rsplit("/", 1)[1]: r["embedding"] for r in readers.float_arrays(found).collect()}
    assert got == {"a.npz:x": [1.0] * 4, "a.npz:y": [0.0] * 3}


def test_snapshot_preference(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "id long, v double")
    rows.write.parquet(f"{tmp_path}/base")
    first = lambda: readers.snapshot(spark, str(tmp_path), ("large", "base"), "id")
    assert first().columns == ["id", "v"]
    spark.createDataFrame([(1, "n")], "id long, name string").write.parquet(f"{tmp_path}/metadata")
    rows.withColumn("v", F.lit(3.0)).write.parquet(f"{tmp_path}/large")
    assert [tuple(r) for r in first().collect()] == [(1, 3.0, "n")]


def test_fetched(spark, tmp_path):
    def get(url, seconds):
        if "bad" in url:
            raise OSError("status 404")
        return url.encode()

    urls = spark.createDataFrame([("u/1",), ("u/1",), ("u/2",), ("u/bad",), (None,)], "url string")
    got = readers.fetched(urls, urls.where("url = 'u/2'"), get).collect()
    assert {(r["url"], r["content"] and bytes(r["content"]), r["error"]) for r in got} == {("u/1", b"u/1", None), ("u/bad", None, "status 404")}


def test_generated(spark):
    rows = spark.createDataFrame([(1, "What?"), (None, "What?"), (2, None)], "image int, prompt string")
    good = encoders.generated(rows, "image", "prompt", lambda images, prompts: [f"{p} seen {i:.0f}" for i, p in zip(images, prompts, strict=True)])
    assert [r["output"] for r in good.collect()][:2] == ["seen 1", "No image available for processing"]

    def fails(images, prompts):
        raise ValueError("no model")

    assert encoders.generated(rows.limit(1), "image", "prompt", fails).first()["output"] == "Error: no model"


def test_index_resumes_and_is_searched(spark, sf, tmp_path):
    """A stream that ends and goes on from its checkpoint encodes each row once; the folder is searched as a table."""
    rows = table(spark, sf, "benchmark")
    folder, encode = f"{tmp_path}/index", lambda b: encoders.encode(b, "item_id", "text").withColumnRenamed("item_id", "key")
    for part in (0, 1):
        rows.where(F.col("item_id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
        streams.indexed(streams.files(spark, f"{tmp_path}/in", rows.schema), encode, folder, f"{tmp_path}/c")
    held = spark.read.parquet(folder)
    assert held.count() == held.select("key").distinct().count() == rows.count()
    index = held.select(F.col("key").alias("vec_id"), "embedding")
    best = search.top_k(index, index, 1)
    assert best.where("score < 0.999").count() == 0 and best.count() == rows.count()


def test_coalesced(spark, sf, tmp_path, events):
    rows, stream = events
    seen: list[int] = []
    query = streams.coalesced(stream, lambda b, n: seen.append(b.count()), f"{tmp_path}/c", 50)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(seen) == rows.count()


def test_until(spark, events, tmp_path):
    """A stream stops after so many rows, in the middle of a batch; a longer wish gets all there is."""
    rows, stream = events
    seen = []
    assert streams.until(stream, 120, lambda b, n: seen.append(b.count()), f"{tmp_path}/u1") == 120 and sum(seen) == 120 and len(seen) == 2
    assert streams.until(stream, 10_000, lambda b, n: None, f"{tmp_path}/u2") == rows.count()
