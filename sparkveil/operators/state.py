"""Keyed state over event logs in batch: step counters, replay checks, rings, status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import table

TTL_SECONDS, NONCE_SECONDS, RING = 1800, 60, 50
RECORDS = 500


def micros(ts) -> Column:
    """Microseconds since the epoch of a time with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def session_steps(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds session and step: a key's counter restarts once it has been idle for more than ``ttl`` seconds."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    idle = micros(ts) - micros(F.lag(ts).over(order))
    fresh = F.coalesce((idle > ttl * 1_000_000).cast("int"), F.lit(1))
    found = events.withColumn("session", F.sum(fresh).over(order))
    return found.withColumn("step", F.row_number().over(Window.partitionBy(key, "session").orderBy(ts, tie)).cast("long"))


def session_steps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_steps(table(spark, sf_dir, "events")).select("event_id", "user_id", "session", "step")


def nonce_replay(events: DataFrame, key: str = "user_id", seconds: int = NONCE_SECONDS) -> DataFrame:
    """(event_id, key, accepted): a use is rejected within ``seconds`` of the last *accepted* one.

    An anchored recurrence: rejected uses do not move the anchor.  Keys stream through
    their task in order of time, one batch at a time, so a hot key needs no memory.
    """

    def run(batches):
        last_key, anchor = None, None
        for pdf in batches:
            accepted = []
            for k, t in zip(pdf["k"].tolist(), pdf["us"].tolist(), strict=True):
                if k != last_key or t - anchor > seconds * 1_000_000:
                    last_key, anchor = k, t
                    accepted.append(True)
                else:
                    accepted.append(False)
            yield pd.DataFrame({"event_id": pdf["event_id"], "k": pdf["k"], "accepted": accepted})

    rows = events.select("event_id", F.col(key).alias("k"), micros("ts").alias("us")).repartition("k").sortWithinPartitions("k", "us", "event_id")
    return rows.mapInPandas(run, "event_id long, k long, accepted boolean").withColumnRenamed("k", key)


def nonce_replay_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nonce_replay(table(spark, sf_dir, "events"), seconds=3600)


def last_of(events: DataFrame, key: str, most: int) -> DataFrame:
    """The last rows of each key, newest first (k); a task passes on no more than that before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.select(key, "event_id", "ts").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select(key, "event_id", F.col("k").cast("long").alias("k"))


def recent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events of each user (T5)."""
    return last_of(table(spark, sf_dir, "events"), "user_id", RING)


def profiler_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 records of each kind of event (T4)."""
    return last_of(table(spark, sf_dir, "events"), "event_type", RECORDS)


TERMINAL = ("TASK_DONE", "TASK_EXHAUSTED", "TASK_STOPPED", "LOOP_ERROR")
STEPS = 10


def runs(log: DataFrame, steps: int = STEPS) -> DataFrame:
    """(session_id, task_id, steps, last_event, outcome) of agent runs from a log of status events.

    ``log``: session_id, task_id, ts, ord, event.  A run ends with its first terminal event; one without has either used up
    its steps or is still open.
    """
    at = F.struct("ts", "ord")
    ended = F.min_by(F.when(F.col("event").isin(*TERMINAL), F.col("event")), F.when(F.col("event").isin(*TERMINAL), at))
    got = log.groupBy("session_id", "task_id").agg(F.count_if(F.col("event") == "STEP_STARTED").alias("steps"), F.max_by("event", at).alias("last_event"), ended.alias("ended"))
    return got.select("session_id", "task_id", "steps", "last_event", F.coalesce("ended", F.when(F.col("steps") >= steps, "TASK_EXHAUSTED").otherwise("OPEN")).alias("outcome"))


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a derived log: a session a user, a task a week."""
    names = F.array(*map(F.lit, ("STEP_STARTED", "ACTION_DECIDED", "ACTION_EXECUTED")))
    event = F.when(F.col("event_id") % 29 == 0, F.element_at(F.array(*map(F.lit, TERMINAL)), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(micros("ts") / 604_800_000_000).alias("task_id"), "ts", F.col("event_id").alias("ord"), event.alias("event"))
    return runs(log)


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last status, first and last time and number of events of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def fresh_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, and how many came within 60 s of the whole hour."""
    now = F.date_trunc("hour", F.col("ts") + F.expr("interval 30 minutes"))
    near = F.abs(micros("ts") - micros(now)) <= 60_000_000
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("events"), F.count_if(near).alias("fresh"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by conversation and role, the last ten kept."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")).withColumn("k", F.row_number().over(order)).where("k <= 10")
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum("n").cast("long").alias("chars"))


QUERIES = {"profiler_ring": profiler_ring, "agent_runs": agent_runs, "session_steps": session_steps_query, "nonce_replay": nonce_replay_query, "recent_ring": recent_ring, "status_fold": status_fold, "fresh_requests": fresh_requests, "conversation_turns": conversation_turns}
ORACLE = {
    "session_steps": """WITH s AS (SELECT event_id, user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS n FROM events))
        SELECT event_id, user_id, CAST(session AS BIGINT) AS session, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS step FROM s""",
    "nonce_replay": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT event_id, user_id, k, t AS anchor, true AS accepted FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - anchor > 3600000000 THEN e.t ELSE anchor END, e.t - anchor > 3600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
        SELECT event_id, user_id, accepted FROM r""",
    "profiler_ring": "SELECT event_type, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 500",
    "agent_runs": """WITH l AS (SELECT user_id AS session_id, CAST(floor(epoch_us(ts) / 604800000000.0) AS BIGINT) AS task_id, ts, event_id, CASE WHEN event_id % 29 = 0 THEN ['TASK_DONE', 'TASK_EXHAUSTED', 'TASK_STOPPED', 'LOOP_ERROR'][event_id % 4 + 1] ELSE ['STEP_STARTED', 'ACTION_DECIDED', 'ACTION_EXECUTED'][event_id % 3 + 1] END AS event FROM events),
        g AS (SELECT session_id, task_id, count(*) FILTER (event = 'STEP_STARTED') AS steps, last(event ORDER BY ts, event_id) AS last_event, first(event ORDER BY ts, event_id) FILTER (event_id % 29 = 0) AS ended FROM l GROUP BY 1, 2)
        SELECT session_id, task_id, steps, last_event, coalesce(ended, CASE WHEN steps >= 10 THEN 'TASK_EXHAUSTED' ELSE 'OPEN' END) AS outcome FROM g""",
    "recent_ring": "SELECT user_id, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50",
    "status_fold": "SELECT user_id, last(event_type ORDER BY ts, event_id) AS last_event, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id",
    "fresh_requests": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(*) FILTER (abs(epoch_us(ts) - epoch_us(date_trunc('hour', ts + INTERVAL 30 MINUTE))) <= 60000000) AS fresh FROM events GROUP BY 1",
    "conversation_turns": "SELECT conv_id, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10 GROUP BY conv_id, role",
}
