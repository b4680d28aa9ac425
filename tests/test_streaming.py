"""Stateful operators over small streams."""

import datetime as dt

import pandas as pd
from corpusgauge.streaming import incremental, limits, telemetry


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def collect(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(s):
    return dt.datetime(2025, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


def test_rate_limit(spark, tmp_path):
    rows = [("k", i, at(t)) for i, t in enumerate([0, 1, 2, 3, 61, 62])] + [("other", 9, at(0))]
    df = limits.rate_limited(stream(spark, tmp_path / "a", rows, "key string, event_id bigint, ts timestamp"), limit=2, seconds=60)
    got = {r.event_id: r.accepted for r in collect(spark, df, "limited")}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True}


def test_job_leases(spark, tmp_path):
    rows = [("j", at(0), "enqueue", ""), ("j", at(1), "claim", "w1"), ("j", at(2), "claim", "w2"), ("j", at(90), "claim", "w2"), ("j", at(95), "complete", "w1"), ("j", at(96), "complete", "w2")]
    df = limits.job_states(stream(spark, tmp_path / "b", rows, "job_id string, ts timestamp, action string, worker string"))
    got = collect(spark, df, "leases", "update")
    assert [(r.state, r.attempts, r.worker) for r in got] == [("succeeded", 2, "w2")]


def test_a_lease_runs_out_without_another_event_of_its_job(spark, tmp_path):
    schema = "job_id string, ts timestamp, action string, worker string"
    df = limits.job_states(stream(spark, tmp_path / "l", [("j", at(0), "enqueue", ""), ("j", at(1), "claim", "w1")], schema))
    q = df.writeStream.format("memory").queryName("expiring").outputMode("update").start()
    q.processAllAvailable()
    assert [(r.job_id, r.state) for r in spark.table("expiring").collect()] == [("j", "running")]
    stream(spark, tmp_path / "l", [("other", at(500), "enqueue", "")], schema)
    q.processAllAvailable()
    q.stop()
    assert ("j", "queued", 1, "") in {tuple(r) for r in spark.table("expiring").collect()}


def test_incremental(spark, tmp_path):
    schema = "id string, content string, ingested_at timestamp"
    spark.createDataFrame([("a", "x", at(0)), ("b", "x", at(1)), ("c", "y", at(2))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = incremental.feed(spark, str(tmp_path / "in"), schema)
    incremental.scan(feed, lambda df: df.select("id", "content"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [(i, at(i * 600), i % 3, "view", float(i)) for i in range(30)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    live = collect(spark, telemetry.tumbling(stream(spark, tmp_path / "e", rows, schema), late="0 seconds"), "tumbling")
    batch = telemetry.tumbling(spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]), schema)).collect()
    closed = {(r.start, r.n) for r in live}
    assert closed <= {(r.start, r.n) for r in batch} and len(closed) >= 3
