"""Keyed state, listeners, the event source and the bucketed cache."""

from __future__ import annotations

import base64
import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.sources import events, scratch
from quillon.sources.cache_table import BucketedCache
from quillon.sources.readers import table
from quillon.streaming import listener, state, streams

EVENTS = "event_id long, ts timestamp, user_id long"
START = datetime(2024, 1, 1)


def appended(df, spark, folder, checkpoint):
    with state.rocksdb(spark):
        streams.drained(df, folder, checkpoint)
    return spark.read.schema(df.schema).parquet(folder)


def put(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_rate_limit_out_of_order_and_restarted(spark, tmp_path):
    """Rows come shuffled, the stream ends and goes on from its checkpoint: the same as over all rows in order."""
    r = random.Random(4)
    rows = [(k, START + timedelta(seconds=20 * k + r.random()), k % 3 if k % 50 else None) for k in range(200)]
    feed = f"{tmp_path}/feed"
    limited = lambda: state.rate_limited(streams.files(spark, feed, spark.createDataFrame([], EVENTS).schema), "user_id", 2, 300_000, "10 minutes")
    for part in (rows[:90], rows[90:]):
        put(spark, r.sample(part, len(part)), feed)
        got = appended(limited(), spark, f"{tmp_path}/out", f"{tmp_path}/c")
    late = max(t for _, t, _ in rows) - timedelta(minutes=10)
    want, seen = {}, defaultdict(int)
    for i, t, u in sorted(rows, key=lambda x: (x[1], x[0])):
        window = (t - START) // timedelta(minutes=5)
        if u is not None and START + (window + 1) * timedelta(minutes=5) <= late:
            seen[u, window] += 1
            want[i] = (u, seen[u, window], seen[u, window] <= 2)
    assert {x["event_id"]: (x["key"], x["place"], x["allowed"]) for x in got.collect()} == want and got.count() == len(want) > 100
    with pytest.raises(ValueError):
        state.rate_limited(spark.createDataFrame([], EVENTS), "user_id", -1)


def test_cool_down_is_carried_from_window_to_window(spark, tmp_path):
    rows = [(k, START + timedelta(minutes=7 * k), k % 2) for k in range(120)]
    put(spark, rows, f"{tmp_path}/feed")
    got = appended(state.cooled_down(streams.files(spark, f"{tmp_path}/feed", spark.createDataFrame([], EVENTS).schema), "user_id", 5_400_000), spark, f"{tmp_path}/out", f"{tmp_path}/c")
    last, want = {}, {}
    for i, t, u in rows:
        if (t.replace(minute=0) + timedelta(hours=1)) <= rows[-1][1]:
            want[i] = u not in last or t - last[u] >= timedelta(minutes=90)
            last[u] = t if want[i] else last[u]
    assert {x["event_id"]: x["acts"] for x in got.collect()} == want and 0 < sum(want.values()) < len(want)


def test_a_key_waits_with_one_timer(spark, tmp_path, monkeypatch):
    """Whatever the number of windows that a batch closes, the rows of a key are read and written once."""
    calls = f"{tmp_path}/calls"

    class Counted(state.RateLimit):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            with open(calls, "a") as f:
                f.write("x")
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    monkeypatch.setattr(state, "RateLimit", Counted)
    rows = [(k, START + timedelta(minutes=k), 1) for k in range(500)]
    for part in (rows[:250], rows[250:]):
        put(spark, part, f"{tmp_path}/feed")
    got = appended(state.rate_limited(streams.files(spark, f"{tmp_path}/feed", spark.createDataFrame([], EVENTS).schema), "user_id", 2, 300_000), spark, f"{tmp_path}/out", f"{tmp_path}/c")
    assert {(r["event_id"], r["place"], r["allowed"]) for r in got.collect()} == {(k, k % 5 + 1, k % 5 < 2) for k in range(495)}
    assert len(open(calls).read()) <= 3


def test_talks_expire(spark, tmp_path):
    """Parts that are older than their time to live are no longer in the transcript."""
    schema = "key long, turn long, role string, text string"
    seen = []
    for n, rows in enumerate(([(1, 0, "user", "a\nb"), (1, 1, "assistant", None)], [(1, 2, "user", "c"), (2, 0, "user", "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        with state.rocksdb(spark):
            streams.each_batch(state.talks(streams.files(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema), 1 if n else 86_400_000), lambda b, _: seen.append({r["key"]: r["transcript"] for r in b.collect()}), f"{tmp_path}/c{n}", "update", idle=False, limit=300)
    assert seen[0] == {1: "User: ab | AI:  | "}
    assert seen[-1][2] in ("User: d | ", "") and "ab" not in seen[-1].get(1, "")


def test_listener_over_a_restart(spark, sf, tmp_path):
    """Metrics of every batch before and after a restart add up to those of all rows."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with listener.Telemetry(spark, f"{tmp_path}/told", every=1) as told:
        for part in (0, 1):
            rows.where(F.col("event_id") % 2 == part).repartition(2).write.mode("append").parquet(f"{tmp_path}/feed")
            fed = listener.observed(streams.files(spark, f"{tmp_path}/feed", rows.schema), "seen", n=F.count("*"), top=F.max("value"), kind=F.max("event_type"))
            query = fed.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination()
            assert told.wait(query) and listener.latest(query)["batchId"] >= 1
        got = told.table().where("rows > 0").collect()
    assert len(got) == 4 and len({r["run_id"] for r in got}) == 2 and sorted(r["batch"] for r in got) == [0, 1, 2, 3]
    assert sum(r["metrics"]["seen.n"] for r in got) == sum(r["rows"] for r in got) == rows.count()
    assert max(r["metrics"]["seen.top"] for r in got) == rows.agg(F.max("value")).first()[0] and "seen.kind" not in got[0]["metrics"]


LINES = [
    {"event": "start", "start": {"streamSid": "s1"}},
    {"event": "media", "streamSid": "s1", "media": {"payload": base64.b64encode(b"\x00\x01").decode()}},
    {"type": "response.audio_transcript.done", "transcript": "hello\nthere"},
    {"event": "media", "media": {"payload": "***"}},
    [1, 2],
]


def test_event_source(spark, tmp_path):
    spark.dataSource.register(events.EventSource)
    folder, write = tmp_path / "in", lambda n, lines: (tmp_path / "in" / f"{n}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    folder.mkdir()
    read = lambda: spark.read.format("json_events").option("files_per_task", 2).load(str(folder))
    assert read().count() == 0
    write("001", LINES)
    write("002", ["", "{broken", "  ", json.dumps({"event": "é"})])
    (folder / "_003.json").write_text("{}")
    (folder / "004.txt").write_text("{}")
    got = {(r["file"], r["line"]): r for r in read().collect()}
    assert sorted(got) == [("001.json", k) for k in range(1, 6)] + [("002.json", 2), ("002.json", 4)]
    assert [got["001.json", k]["event"] for k in range(1, 6)] == ["start", "media", "response.audio_transcript.done", "media", None]
    assert got["001.json", 1]["stream"] == "s1" and bytes(got["001.json", 2]["payload"]) == b"\x00\x01" and got["001.json", 3]["text"] == "hello\nthere"
    assert "base 64" in got["001.json", 4]["error"] and got["001.json", 5]["error"] == "no object" and "no JSON" in got["002.json", 2]["error"] and got["002.json", 4]["event"] == "é"
    with pytest.raises(Exception, match="path"):
        spark.read.format("json_events").load().count()


def test_event_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(events.EventSource)
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        for k in range(4):
            (folder / f"{n}{k}.json").write_text("\n".join(json.dumps({"event": "e", "text": f"{n}{k}{j}"}) for j in range(5)))
        stream = spark.readStream.format("json_events").option("files_per_task", 3).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        got = [r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert sorted(got) == [f"{a}{b}{j}" for a in range(n + 1) for b in range(4) for j in range(5)]


def exchanges(df):
    """Where the plan shuffles: the leaves below each exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_bucketed_cache(spark, tmp_path):
    at = lambda k: START + timedelta(minutes=k)
    cache = BucketedCache(spark, "cached_vectors", scratch.folder(spark, "cache"), 4)
    rows = lambda ks, m: spark.createDataFrame([(f"k{k}", [float(k), float(m)], at(m)) for k in ks], "key string, embedding array<double>, at timestamp")
    cache.put(rows(range(50), 0))
    cache.put(rows(range(40, 60), 5))
    cache.put(spark.createDataFrame([(None, [1.0], at(0)), ("x", [1.0], None)], "key string, embedding array<double>, at timestamp"))
    keys = spark.createDataFrame([("k1",), ("k45",), ("k45",), ("k99",), (None,)], "key string")
    want = sorted([("k1", [1.0, 0.0], True), ("k45", [45.0, 5.0], True), ("k45", [45.0, 5.0], True), ("k99", None, False), (None, None, False)], key=repr)
    found = lambda c: sorted([(r["key"], r["embedding"], r["hit"]) for r in c.lookup(keys).collect()], key=repr)
    assert found(cache) == want and cache.latest().count() == 60
    assert [r["key"] for r in cache.missing(keys).collect()] == ["k99"]
    assert cache.lookup(keys, "2024-01-01 00:03:00").where("hit").count() == 2
    n, plan = exchanges(cache.lookup(keys))
    assert n == 1 and "Bucketed: true" in plan, plan  # the one is that of the asked keys
    again = BucketedCache(spark, "cached_vectors", cache.folder, 4)  # the files are there for another session
    assert found(again) == want
    again.compact()
    assert found(again) == want and spark.table("cached_vectors").count() == 60 and exchanges(again.lookup(keys))[0] == 1


def test_read_through_table(spark, sf, tmp_path):
    """Two runs from one checkpoint: every key is computed once."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "event_id")
    cache = BucketedCache(spark, "read_through_cache", scratch.folder(spark, "cache"), 4)
    asked = spark.sparkContext.accumulator(0)

    def compute(keys):
        asked.add(keys.count())
        return keys.withColumn("embedding", F.array(F.length("key").cast("double")))

    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).repartition(2).write.mode("append").parquet(f"{tmp_path}/feed")
        streams.read_through_table(streams.files(spark, f"{tmp_path}/feed", rows.schema).select("key"), cache, compute, f"{tmp_path}/c")
    users = rows.select("key").distinct().count()
    assert asked.value == users == spark.table("read_through_cache").count() == cache.latest().count()
