"""Batch forms of the stream operators, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import jobs as J
from ..streaming import stateful as K
from .catalogue import query

JOBS = "SELECT event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'completed' END AS status, ts AS started_at, CASE WHEN event_id % 3 > 0 THEN ts + to_seconds(event_id % 90) END AS heartbeat_at, (event_id % 5)::INTEGER AS retry_count FROM events"


@query(
    "stale_jobs",
    f"""WITH j AS ({JOBS}), m AS (SELECT max(ts) AS now FROM events), l AS (SELECT *, status = 'running' AND coalesce(heartbeat_at, started_at) < now - INTERVAL 60 SECOND AS late FROM j, m)
SELECT job_id, CASE WHEN late AND retry_count < 3 THEN 'queued' WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN late AND retry_count >= 3 THEN 'heartbeat_timeout' END AS error FROM l""",
)
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    beat = F.when(F.col("event_id") % 3 > 0, F.expr("ts + make_dt_interval(0, 0, 0, event_id % 90)"))
    jobs = events.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type").isin("click", "view"), "running").otherwise("completed").alias("status"), F.col("ts").alias("started_at"), beat.alias("heartbeat_at"), (F.col("event_id") % 5).cast("int").alias("retry_count"))
    return J.recovered(jobs, F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    return J.windowed(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 2))


@query("sliding_window", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(2) r(k) GROUP BY ALL")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return J.windowed(table(spark, d, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 2))


@query(
    "session_window",
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM s)
SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, s""",
)
def session_window(spark: SparkSession, d: str) -> DataFrame:
    return J.sessions(table(spark, d, "events"), "2 hours")


@query("login_throttle")
def login_throttle(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") != "purchase").alias("failed"))
    return J.throttle(events)


@query("idempotent_jobs", "SELECT user_id AS project_id, (event_id % 100)::BIGINT AS idempotency_key, arg_min(event_id, (ts, event_id)) AS job_id FROM events GROUP BY ALL")
def idempotent_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("project_id"), (F.col("event_id") % 100).alias("idempotency_key"), F.col("event_id").alias("job_id"), F.col("ts").alias("queued_at"))
    return J.first_of_key(rows).select("project_id", "idempotency_key", "job_id")


HOURS = 3600 * K.SECOND
#: A user's signups start a job, views and clicks are its heartbeats, a purchase ends it; time has gone to the last event.
WATCHED = "CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'ended' ELSE 'heartbeat' END"


@query(
    "job_timeouts",
    f"""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events), e AS (SELECT user_id, epoch_us(ts) AS us, event_id, {WATCHED} AS kind FROM events WHERE event_type <> 'error'),
w AS (SELECT *, sum((kind <> 'heartbeat')::INTEGER) OVER o AS run, sum((kind = 'ended')::INTEGER) OVER o AS life, coalesce(lead(us) OVER o, now) AS next FROM e, n WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT user_id, life, min(CASE WHEN next - us > {12 * HOURS} THEN us END) + {12 * HOURS} AS lost_at FROM w GROUP BY user_id, life, run HAVING bool_or(kind = 'started')),
k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, life ORDER BY lost_at) - 1) % 4 AS k FROM r WHERE lost_at IS NOT NULL)
SELECT user_id, lost_at, CASE WHEN k < 3 THEN 'queued' ELSE 'failed' END AS status, least(k + 1, 3)::BIGINT AS retry_count, 'worker_heartbeat_timeout' AS error FROM k""",
)
def job_timeouts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = events.agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    watched = events.filter("event_type <> 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("number"), "ts", F.expr(WATCHED).alias("kind"))
    return K.over_batch(watched, K.LostJobs(timeout=12 * HOURS), now).withColumnsRenamed({"key": "user_id", "at": "lost_at"})
