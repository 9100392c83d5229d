"""Streaming jobs (R) over the events table, read as a stream until it is used up."""

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import cursors
from tessera.sources.store import fresh_path
from tessera.streaming import jobs


def events(t, ts=None):
    return jobs.source(t.spark, f"{t.dir}/events.parquet", ts)


@query("r05_latest_stream", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")  # R5, R8
def _(t):
    return jobs.merged(events(t).select("user_id", "event_id", "value"), "user_id", ["event_id"])


@query("r06_append_stream", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")  # R6
def _(t):
    return jobs.appended(events(t).where("event_type = 'error'").select("event_id", "user_id"))


@query("r10_tool_stats_stream", "SELECT event_type, count(*) AS call_count, round(sum(value), 4) AS success_time FROM events GROUP BY 1")  # R10
def _(t):
    s = events(t).groupBy("event_type").agg(F.count("*").alias("call_count"), F.sum("value").alias("success_time"))
    return jobs.result(s).withColumn("success_time", F.round("success_time", 4))


@query("r11_windows_stream", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")  # R11
def _(t):
    s = jobs.tumbling(events(t, "ts"), "ts", "1 hour", ["event_type"], n=F.count("*"))
    return jobs.result(s).select(F.unix_seconds("w.start").alias("hour"), "event_type", "n")


@query("r12_cursors", "SELECT user_id, event_id, CASE WHEN event_id <= 400 THEN 1 ELSE 2 END AS batch FROM events WHERE event_type <> 'view'")  # R12
def _(t):
    """The log as it was, read twice before it is confirmed, then as it is."""
    root, log = fresh_path(t.spark, "cursors"), t.events.where("event_type <> 'view'").select("user_id", "event_id")
    cursors.pending(log.where("event_id <= 400"), root, "user_id", "event_id")
    number, first = cursors.pending(log, root, "user_id", "event_id")  # still the same batch
    cursors.confirm(t.spark, root, number, "user_id", "event_id")
    again, second = cursors.pending(log, root, "user_id", "event_id")
    return first.withColumn("batch", F.lit(number)).unionByName(second.withColumn("batch", F.lit(again)))
