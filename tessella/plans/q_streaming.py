"""Streaming queries T01-T06: the event table replayed as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans import derived as dv
from tessella.plans.q_lifecycle import incoming, linked
from tessella.plans.registry import query
from tessella.sources.files import scratch
from tessella.streaming import ledger as lg


def events(spark, d):
    e = lg.read_stream(spark, d, dv.table(spark, d, "events").schema, glob="events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _attempts(e):
    return e.select(F.col("ts").alias("created_at"), F.col("event_type").alias("service"), F.when(F.col("value") < 90, "succeeded").otherwise("failed").alias("status"),
                    F.col("value").alias("latency_ms"))


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@query("t01_attempt_windows", f"""
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS service, count(*) AS attempts, count(*) FILTER (WHERE value >= 90) AS failures, round(avg(value), 6) AS avg_latency
  FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1, 2
""")
def t01(spark, d):
    out = lg.drain(lg.attempt_windows(_attempts(events(spark, d))))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")).withColumn("avg_latency", F.round("avg_latency", 6))


@query("t01_attempt_windows_batch", """
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS service, count(*) AS attempts, count(*) FILTER (WHERE value >= 90) AS failures, round(avg(value), 6) AS avg_latency
  FROM events GROUP BY 1, 2
""")
def t01b(spark, d):
    out = lg.attempt_windows(_attempts(dv.table(spark, d, "events")))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")).withColumn("avg_latency", F.round("avg_latency", 6))


def _stages(e):
    v = F.col("value")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"),
                    F.when(v < 30, "started").when(v < 120, "completed").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))


@query("t02_current_stages", """
  SELECT run_id, document_id, stage, status FROM stage_events QUALIFY row_number() OVER (PARTITION BY run_id, document_id ORDER BY created_at DESC, event_id DESC) = 1
""", ("stage_events",))
def t02(spark, d):
    s = lg.current_stages(_stages(events(spark, d)))
    return lg.drain_updates(s, ["run_id", "document_id"], ["at"]).drop("at")


# The watermark of two sides is that of the slower one.
@query("t03_stalled_stages", """
  SELECT event_id, run_id, document_id, stage FROM stage_events s WHERE status = 'started' AND created_at + INTERVAL 1 HOUR <
      (SELECT least(max(created_at) FILTER (WHERE status = 'started'), max(created_at) FILTER (WHERE status <> 'started')) FROM stage_events) - INTERVAL 10 MINUTES
    AND NOT EXISTS (SELECT 1 FROM stage_events e WHERE e.run_id = s.run_id AND e.document_id = s.document_id AND e.stage = s.stage AND e.status <> 'started'
                    AND e.created_at > s.created_at AND e.created_at <= s.created_at + INTERVAL 1 HOUR)
""", ("stage_events",))
def t03(spark, d):
    return lg.drain(lg.stalled_stages(_stages(events(spark, d)))).select("event_id", "run_id", "document_id", "stage")


@query("t04_first_submissions", "SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS k FROM events")
def t04(spark, d):
    s = events(spark, d).select("user_id", "event_type", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("k"), "ts")
    return lg.drain(lg.first_submissions(s, ["user_id", "event_type", "k"], "ts", "60 days")).drop("ts")


@query("t05_ingest_stream", """
  SELECT domain, document_id, CASE WHEN NOT known THEN 'NEW' WHEN active_hash = content_hash AND active_complete THEN 'SKIP'
    WHEN active_hash IS NULL AND historical_hash = content_hash AND historical_complete THEN 'RESTORE' ELSE 'UPDATE' END AS action FROM state
""", ("state",))
def t05(spark, d):
    k = linked(spark, d)
    past = k.filter(F.col("linked_at") < F.lit(dv.PARENT_UNTIL).cast("timestamp")).select("domain", "document_id", "snapshot_id", "content_hash", "linked_at")
    act = dv.parent_selections(spark, d).filter("selection_status = 'active'").select("domain", "document_id", "snapshot_id").join(k.select("snapshot_id", "content_hash"), "snapshot_id")
    done = dv.table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("snapshot_id"))
    # Arriving documents land as files and are picked up by the stream.
    inbox, new = scratch(spark), incoming(spark, d)
    new.repartition(2).write.parquet(inbox)
    return lg.ingest_stream(lg.read_stream(spark, inbox, new.schema, 1), past, act, done).select("domain", "document_id", "action")


@query("t06_sessions", f"""
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS queries FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTES <= {CLOSED}
""")
def t06(spark, d):
    e = events(spark, d).select("user_id", F.col("ts").alias("created_at"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return lg.drain(lg.sessions(e)).select("user_id", text("session_start"), text("session_end"), "queries")


@query("t06_sliding_activity", f"""
  WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - o AS window_start, event_type FROM events, (SELECT unnest([INTERVAL 0 MINUTES, INTERVAL 30 MINUTES]) AS o))
  SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS queries FROM w WHERE window_start + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1, 2
""")
def t06b(spark, d):
    e = events(spark, d).select("event_type", F.col("ts").alias("created_at"))
    return lg.drain(lg.sliding_activity(e)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
