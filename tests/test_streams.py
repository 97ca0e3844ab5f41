"""Structured Streaming forms against their batch results."""

import datetime

from lodestrata.streaming import jobs
from pyspark.sql import functions as F


def run(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i // 60, i % 60), i % 3) for i in range(0, 180, 7)]
    spark.createDataFrame(rows, "id long, ts timestamp, user long").repartition(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("id long, ts timestamp, user long").parquet(str(tmp_path / "in"))


def test_windows_sessions_and_dedupe(spark, tmp_path):
    s = events(spark, tmp_path)
    got = run(jobs.windows(s, "ts", "1 hour", "10 minutes", ["user"]), "w1", "complete", tmp_path / "c1")
    assert got.agg(F.sum("n")).first()[0] == 26
    got = run(jobs.sessions(s, "ts", "30 minutes", "10 minutes", "user"), "w2", "complete", tmp_path / "c2")
    assert got.agg(F.sum("n")).first()[0] == 26
    got = run(jobs.dedupe(s.select("ts", "user"), "ts", "2 hours", ["user"]), "w3", "append", tmp_path / "c3")
    assert got.count() == 3


def test_lease_state_machine(spark, tmp_path):
    steps = [(1, "claim", 1), (1, "done", 2), (2, "claim", 1), (2, "fail", 2), (2, "claim", 3), (3, "done", 1)] + [(4, e, 2 * i + k) for i in range(6) for k, e in enumerate(("claim", "fail"))]
    spark.createDataFrame(steps, "job_id long, event string, at long").repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("job_id long, event string, at long").parquet(str(tmp_path / "in"))
    got = {r.job_id: (r.status, r.attempts) for r in run(jobs.lease_states(s), "w4", "update", tmp_path / "c").collect()}
    assert got == {1: ("done", 1), 2: ("running", 2), 3: ("queued", 0), 4: ("dead", 5)}


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = jobs.upsert_sink(str(tmp_path / "t"), ["k"], "at")
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    b = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, at long")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    read = lambda: sorted(tuple(r) for r in jobs.read_upserts(spark, str(tmp_path / "t")).collect())
    assert read() == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    write(spark.createDataFrame([(1, "old", 0)], "k long, v string, at long"), 2)
    (tmp_path / "t/epoch=3/_bucket=0").mkdir(parents=True)  # begun, never whole
    assert read() == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


def test_queue(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    q = spark.createDataFrame([(1, "queued", 0, 5), (2, "queued", 1, 3), (3, "running", 1, 1)], "job_id long, state string, attempts int, updated_at long").withColumn("lease_until", F.lit(None).cast("timestamp"))
    got = {r.job_id: (r.state, r.attempts) for r in jobs.claim(q, now, "20 minutes", 1).collect()}
    assert got == {1: ("queued", 0), 2: ("running", 2), 3: ("running", 1)}
    assert jobs.plan(q, q.limit(2)).count() == 3
