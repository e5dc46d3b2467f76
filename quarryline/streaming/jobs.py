"""Job and event streams: late jobs, login throttling, windows; each rule once, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stateful import Throttle, over_batch, over_stream

TIMEOUT_S, MOST_RETRIES = 60, 3


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs without a heartbeat for TIMEOUT_S go back to the queue, or fail when their retries are used up."""
    late = (F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < now - F.expr(f"interval {TIMEOUT_S} seconds"))
    again = F.col("retry_count") < MOST_RETRIES
    status = F.when(late & again, "queued").when(late, "failed").otherwise(F.col("status"))
    error = F.when(late & ~again, "heartbeat_timeout")
    return jobs.select("job_id", status.alias("status"), F.when(late & again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"), error.alias("error"))


def windowed(events: DataFrame, length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; a lateness makes it fit for append-mode streams."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", lateness) if lateness else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def _attempts(attempts: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("failed", F.lit(False)), "failed").otherwise("succeeded")
    return attempts.select(F.col("key").cast("long").alias("key"), F.col("event_id").alias("number"), "ts", kind.alias("kind"))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("number").alias("event_id"), F.col("failures").cast("int").alias("failures"), "blocked")


def throttle(attempts: DataFrame) -> DataFrame:
    """attempts(key, event_id, ts, failed) with the failures counted and whether the attempt met a block; batch form.

    A key's attempts are one person's or one address's. Those without a key or time are not judged.
    """
    return _answers(over_batch(_attempts(attempts), Throttle()))


def throttle_stream(attempts: DataFrame, clock: str = "arrival", lateness: str = "10 minutes") -> DataFrame:
    """The same over a stream: at once as attempts arrive, or by the clock event in order of their time.

    A key's state goes when its window and block are over.
    """
    return _answers(over_stream(_attempts(attempts), Throttle(), clock, lateness))


def first_of_key(jobs: DataFrame, key: str = "idempotency_key", order: str = "queued_at") -> DataFrame:
    """Of jobs with one idempotency key the first; batch form of dropDuplicates on a stream."""
    w = Window.partitionBy("project_id", key).orderBy(order, "job_id")
    return jobs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_of_key_stream(jobs: DataFrame, lateness: str, key: str = "idempotency_key", order: str = "queued_at") -> DataFrame:
    """Of a stream of jobs the first to arrive of each key; a key is forgotten when the watermark has passed it."""
    return jobs.withWatermark(order, lateness).dropDuplicatesWithinWatermark(["project_id", key])
