"""Batch forms of the streaming operators over events, comparable with SQL; streaming/ has the running ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as rel
from ..streaming import jobs
from .registry import query


@query(sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t):
    g = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query(sql="SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s")
def events_sliding(t):
    return t.events.groupBy(F.window("ts", "60 minutes", "30 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query(sql="""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(t):
    g = t.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


@query(sql="SELECT user_id, event_type, day, min(event_id) AS event_id FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY ALL")
def events_dedupe(t):
    return t.events.groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.min("event_id").alias("event_id"))


@query(sql="""SELECT event_id, CASE WHEN attempts >= 5 AND expired THEN 'dead_letter' WHEN expired THEN 'queued' ELSE 'running' END AS state FROM (
 SELECT event_id, json_extract(props, '$.k')::BIGINT % 8 AS attempts, ts + INTERVAL 20 MINUTE <= TIMESTAMP '2024-01-20' AS expired FROM events WHERE event_type = 'click')""")
def lease_expired(t):
    """Running jobs whose lease ran out go back to the queue, or to the dead letters after five attempts."""
    j = t.events.where("event_type = 'click'").select("event_id", (F.from_json("props", "k long")["k"] % 8).alias("attempts"), (F.col("ts") + F.expr("interval 20 minutes")).alias("lease_until"))
    return jobs.expire(j, F.lit("2024-01-20").cast("timestamp_ntz"), 5).select("event_id", "state")


@query(sql="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(t):
    """Newest row per artifact; the others are superseded."""
    return rel.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(sql="""SELECT event_type, n, errors, CASE WHEN errors >= 0.25 * n THEN 'cooldown' WHEN n > 20 THEN 'cap' ELSE 'ok' END AS health FROM (
 SELECT user_id % 10 AS lane, event_type, count(*) AS n, count_if(value > 50) AS errors FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY ALL)""")
def lane_health(t):
    g = t.events.where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).groupBy((F.col("user_id") % 10).alias("lane"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("errors"))
    return g.select("event_type", "n", "errors", F.when(F.col("errors") >= 0.25 * F.col("n"), "cooldown").when(F.col("n") > 20, "cap").otherwise("ok").alias("health"))


@query(sql="SELECT event_id, user_id FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events WHERE event_type = 'purchase') WHERE round(spent, 6) <= 200")
def ledger_ceiling(t):
    """Reservations in order while their running sum keeps under the ceiling."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("event_type = 'purchase'").withColumn("spent", F.round(F.sum("value").over(w), 6)).where("spent <= 200").select("event_id", "user_id")


@query(sql="""SELECT user_id, count(*) AS n_steps, count_if(NOT legal) AS illegal FROM (SELECT user_id, coalesce((prev IS NULL AND event_type IN ('view', 'signup', 'click')) OR (prev || '>' || event_type) IN ('view>click', 'click>purchase', 'view>view', 'signup>view', 'click>view', 'purchase>view'), false) AS legal
 FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id""")
def outbox_transitions(t):
    """Steps of each key held against the table of legal transitions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    legal = F.concat_ws(">", "prev", "event_type").isin(*jobs.LEGAL)
    x = t.events.withColumn("prev", F.lag("event_type").over(w)).withColumn("legal", F.when(F.col("prev").isNull(), F.col("event_type").isin("view", "signup", "click")).otherwise(legal))
    return x.groupBy("user_id").agg(F.count("*").alias("n_steps"), F.count_if(~F.col("legal")).alias("illegal"))
