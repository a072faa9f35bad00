"""Streaming queries driven to their end over what the tables hold now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.plans.registry import register
from docloom.sources.tables import table
from docloom.streaming import jobs, stateful


def _stream(spark, base, name, order="ts"):
    """A table as a stream of four batches, so that state is carried from one to the next."""
    return jobs.in_batches(table(spark, base, name), order, _name())


def _name():
    return f"docloom_{uuid.uuid4().hex}"


@register("stm1_win11_event_history", """
  WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'error' ELSE event_type || '_step' END AS ev FROM events),
  cut AS (SELECT user_id, min(event_id) FILTER (ev = 'error') AS stop FROM e GROUP BY 1),
  k AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS rn FROM e JOIN cut USING (user_id) WHERE stop IS NULL OR event_id <= stop)
  SELECT user_id AS key, string_agg(ev, ',' ORDER BY event_id) FILTER (rn <= 20) AS events, max(event_id) AS last_seq, bool_or(ev = 'error') AS finished FROM k GROUP BY 1""")
def stm1_win11_event_history(spark, base):
    """State per key: the last 20 events up to a terminal one, as of the last batch."""
    event = F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "error").otherwise(F.concat("event_type", F.lit("_step")))
    stream = jobs.event_history(_stream(spark, base, "events").withColumn("ev", event), "user_id", "event_id", "ev")
    out = jobs.run_to_end(stream, _name(), "update")
    newest = out.groupBy("key").agg(F.max_by(F.struct("events", "last_seq", "finished"), "last_seq").alias("s"))
    return newest.select("key", F.array_join("s.events", ",").alias("events"), "s.last_seq", "s.finished")


@register("stm7_windowed_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm7_windowed_counts(spark, base):
    """Daily counts in complete mode with a watermark wider than the data, so the stream equals the batch."""
    out = jobs.run_to_end(jobs.windowed_counts(_stream(spark, base, "events"), "ts", "event_type"), _name(), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@register("stm2_progress_lines", """
  SELECT CAST(user_id AS VARCHAR) AS document_id, event_type AS stage, CAST(greatest(0, least(100, trunc(value))) AS INTEGER) AS progress FROM events WHERE event_id % 3 <> 0""")
def stm2_progress_lines(spark, base):
    """Prefixed JSON lines become typed events; other lines and broken JSON are skipped."""
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress")))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(jobs.PREFIX), F.lit("{broken"))).otherwise(F.concat(F.lit(jobs.PREFIX), body))
    stream = jobs.progress_events(_stream(spark, base, "events").select(line.alias("value")))
    return jobs.run_to_end(stream, _name(), "append").select("document_id", "stage", "progress")


@register("stm3_log_ring", """
  SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY event_id) AS lines, max(event_id) AS last FROM (
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50) GROUP BY 1""")
def stm3_log_ring(spark, base):
    """Each key's last 50 log lines in order, kept as a ring in the state of a stream."""
    line = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    out = jobs.run_to_end(jobs.event_history(_stream(spark, base, "events").withColumn("line", line), "user_id", "event_id", "line", 50), _name(), "update")
    newest = out.groupBy("key").agg(F.max_by(F.struct("events", "last_seq"), "last_seq").alias("s"))
    return newest.select(F.col("key").alias("user_id"), F.array_join("s.events", ",").alias("lines"), F.col("s.last_seq").alias("last"))


@register("stm6_incremental_snapshots", """
  WITH f AS (SELECT user_id AS answer_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'up' ELSE 'down' END AS sentiment FROM events),
  stop AS (SELECT answer_id, max(id) AS stop FROM f WHERE sentiment <> 'down' GROUP BY 1)
  SELECT answer_id, count(*) AS feedback_count, count(*) FILTER (sentiment = 'up') AS positive_count, count(*) FILTER (sentiment = 'down') AS negative_count,
    count(*) FILTER (sentiment = 'down' AND (stop IS NULL OR id > stop)) AS negative_streak FROM f LEFT JOIN stop USING (answer_id) GROUP BY 1""")
def stm6_incremental_snapshots(spark, base):
    """Quality snapshots kept in state: an event costs its key's few counters, never a reread of past events."""
    e = _stream(spark, base, "events").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "up").otherwise("down").alias("sentiment"))
    out = jobs.run_to_end(jobs.feedback_snapshots(e), _name(), "update")
    names = ("feedback_count", "positive_count", "negative_count", "negative_streak")
    newest = out.groupBy("answer_id").agg(F.max_by(F.struct(*names), "feedback_count").alias("s"))
    return newest.select("answer_id", "s.*")


@register("stm9_subscription", """
  WITH h AS (SELECT user_id, event_id, event_type, ts, max(event_id) FILTER (ts < TIMESTAMP '2024-01-15') OVER (PARTITION BY user_id) AS seen FROM events),
  s AS (SELECT user_id, event_id, 'snapshot' AS origin, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM h WHERE ts < TIMESTAMP '2024-01-15')
  SELECT user_id, event_id, origin FROM s WHERE rn <= 20 UNION ALL
  SELECT user_id, event_id, 'live' FROM h WHERE ts >= TIMESTAMP '2024-01-15' AND (seen IS NULL OR event_id > seen) AND user_id % 10 <> 0""")
def stm9_subscription(spark, base):
    """What a subscriber gets: the snapshot of the history, then the live rows after it; none where the job is finished."""
    e = table(spark, base, "events").select("user_id", "event_id", (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("past"))
    return jobs.subscription(e.where("past"), e.where("not past"), e.where("user_id % 10 = 0").select("user_id").distinct(), "user_id", "event_id").select("user_id", "event_id", "origin")


_JOBS = """e AS (SELECT user_id AS job_id, event_id, ts, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'error' WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'exit' ELSE 'progress' END AS ev,
    event_id % 3 AS code, event_type FROM events)"""


def _job_events(spark, base):
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "error").when((F.col("event_type") == "signup") & (F.col("event_id") % 20 == 0), "exit").otherwise("progress")
    return table(spark, base, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("event"), (F.col("event_id") % 3).alias("exit_code"), F.col("event_type").alias("message")
    )


@register("stm8_flt16_job_ends", f"""
  WITH {_JOBS}, g AS (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS after FROM e),
  m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
  found AS (
    SELECT job_id, event_id, 0 AS o, 'timeout' AS outcome, NULL AS message, before + INTERVAL 2 DAY AS at_time FROM g WHERE ts > before + INTERVAL 2 DAY
    UNION ALL SELECT job_id, event_id, 1, CASE WHEN ev = 'error' THEN 'monitor_error' WHEN code = 0 THEN 'complete' ELSE 'failed' END, event_type, ts FROM g WHERE ev <> 'progress'
    UNION ALL SELECT job_id, event_id, 2, 'timeout', NULL, ts + INTERVAL 2 DAY FROM g, m WHERE after IS NULL AND ts + INTERVAL 2 DAY < mark)
  SELECT job_id, outcome, message, at_time AS ended_at FROM found QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id, o) = 1""")
def stm8_flt16_job_ends(spark, base):
    """Jobs that exit, fail, or fall silent for two days: timers of event time over four batches."""
    name = _name()
    stream = stateful.job_ends(jobs.in_batches(_job_events(spark, base), "ts", name), 2 * 86_400)
    return jobs.run_to_end(stream, name, "append").select("job_id", "outcome", "message", F.col("at").cast("timestamp_ntz").alias("ended_at"))


@register("stm9_stm1_replay_then_live", """
  WITH e AS (SELECT user_id AS key, event_id AS seq, event_type AS event, event_type = 'error' AND event_id % 50 = 0 AS terminal, ts FROM events),
  stop AS (SELECT key, min(seq) FILTER (terminal) AS stop, min(seq) FILTER (terminal AND ts < TIMESTAMP '2024-01-15') AS past_stop, max(seq) FILTER (ts < TIMESTAMP '2024-01-15') AS seen FROM e GROUP BY 1),
  k AS (SELECT * FROM e JOIN stop USING (key) WHERE stop IS NULL OR seq <= stop),
  s AS (SELECT key, seq, event FROM k WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 20)
  SELECT key, seq, event, 'snapshot' AS origin FROM s UNION ALL
  SELECT key, seq, event, 'live' FROM k WHERE past_stop IS NULL AND (seen IS NULL OR seq > seen)""")
def stm9_stm1_replay_then_live(spark, base):
    """A snapshot of the past, then four live batches that begin a day before the snapshot ends; finished keys stay silent."""
    terminal = (F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)
    e = table(spark, base, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), terminal.alias("terminal"), "ts")
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    past, name = e.where(F.col("ts") < day(15)).drop("ts"), _name()
    live = jobs.run_to_end(stateful.live_after(past, jobs.in_batches(e.where(F.col("ts") >= day(14)), "ts", name)), name, "append")
    shown = stateful.snapshot(past).select("key", "seq", "event")
    return shown.withColumn("origin", F.lit("snapshot")).unionByName(live.withColumn("origin", F.lit("live")))
