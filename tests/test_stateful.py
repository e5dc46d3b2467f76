"""Rules with timers: streams against batches and a plain machine, restarts, timers without an event, state that ends."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import jobs as J
from quarryline.streaming import stateful as K

START = 1_700_000_000


def table(spark, rows):
    """rows(key, number, seconds after START, kind)"""
    return spark.createDataFrame(rows, "key long, number long, s double, kind string").select("key", "number", F.timestamp_seconds(F.col("s") + START).alias("ts"), "kind")


def micros(seconds):
    return int((START + seconds) * K.SECOND)


class Source:
    """A folder that a stream reads, file by file, and the file sink and checkpoint of its query."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def add(self, rows):
        part = self.folder / f"part{self.n}"
        table(self.spark, rows).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(self.folder / "in" / f"{self.n}.parquet")
        self.n += 1

    def query(self, rule, clock="event", **trigger):
        self.out = rule.out
        stream = self.spark.readStream.schema("key long, number long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        out = K.over_stream(stream, rule, clock, "30 minutes").writeStream.format("parquet").outputMode("append")
        return out.option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "checkpoint")).trigger(**trigger).start()

    def run(self, rule):
        assert self.query(rule, availableNow=True).awaitTermination(120)

    def rows(self):
        """What the sink has committed."""
        if not (self.folder / "out/_spark_metadata/0").exists():
            return []
        return sorted(map(tuple, self.spark.read.schema(f"key long, {self.out}").parquet(str(self.folder / "out")).collect()))


def drawn(kinds):
    r = random.Random(len(kinds))
    return [(r.randrange(6), i, i * 9 + r.randrange(-200, 200) * 1.0, r.choice(kinds)) for i in range(300)]


@pytest.mark.parametrize(("rule", "kinds"), [(K.LostJobs(), ["started", "heartbeat", "heartbeat", "heartbeat", "ended"]), (K.Throttle(), ["failed"] * 8 + ["ok"])])
def test_streams_agree_with_batches_whatever_the_order_and_across_restarts(spark, tmp_path, rule, kinds):
    rows, source = drawn(kinds), Source(spark, tmp_path)
    random.Random(1).shuffle(rows[:150])
    want = sorted(map(tuple, K.over_batch(table(spark, rows), rule, micros(48_200)).collect()))
    seen = 0
    for part in (rows[:150], rows[150:], [(99, 10**6, 50_000.0, "other")]):  # the last one moves the watermark to 48,200
        source.add(part)
        source.run(rule)  # a new query on the old checkpoint
        source.run(rule)  # without new files: nothing comes twice
        assert seen <= len(source.rows())
        seen = len(source.rows())
    assert len(want) > 20 and [r for r in source.rows() if r[0] != 99] == want


def test_a_job_is_lost_without_another_event_of_it(spark, tmp_path):
    source = Source(spark, tmp_path)
    source.add([(1, 0, 0.0, "started"), (1, 1, 50.0, "heartbeat"), (2, 2, 0.0, "started"), (2, 3, 100.0, "ended"), (3, 4, 20.0, "heartbeat")])
    source.add([(7, 5, 4000.0, "heartbeat")])  # only another job's event
    source.run(K.LostJobs(most_retries=0))
    assert source.rows() == [(1, micros(110), "failed", 0, "worker_heartbeat_timeout"), (2, micros(60), "failed", 0, "worker_heartbeat_timeout")]


def test_the_wall_clock_fires_timers(spark, tmp_path):
    source = Source(spark, tmp_path)
    source.add([(1, 0, time.time() - START, "started"), (2, 1, time.time() - START - 3600, "started")])
    q = source.query(K.LostJobs(timeout=8 * K.SECOND), "processing", processingTime="1 second")
    try:
        end = time.time() + 90
        while time.time() < end and len(source.rows()) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r[0], r[2], r[3]) for r in source.rows()] == [(1, "queued", 1), (2, "queued", 1)]


def test_state_goes_when_window_and_block_are_over(spark, tmp_path):
    source = Source(spark, tmp_path)
    source.add([(1, i, float(i), "failed") for i in range(5)] + [(2, 9, 0.0, "failed"), (3, 10, 0.0, "ok")])
    source.add([(4, 11, 2700.0, "ok")])  # watermark 900: key 2's window is over at 900, key 1's block at 904
    source.run(K.Throttle())

    def states():
        return {r.key.key for r in spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "state").load().collect()}

    assert states() == {1}
    source.add([(4, 12, 2710.0, "ok")])
    source.run(K.Throttle())
    assert states() == set()


def walked(rule, events, now):
    state, out = None, []
    for e in sorted(events):
        for state, row in K.advanced(rule, state, [e], None):  # noqa: B007
            out += [row] if row else []
    return out + [row for _, row in K.advanced(rule, state, [], now) if row]


def test_rules_by_hand():
    job = K.LostJobs(timeout=10, most_retries=1)
    events = [K.Event(at, i, kind, 0) for i, (at, kind) in enumerate([(0, "heartbeat"), (1, "started"), (11, "heartbeat"), (22, "heartbeat"), (23, "started"), (40, "started"), (45, "ended"), (50, "started")])]
    late = "worker_heartbeat_timeout"
    assert walked(job, events, 60) == [(21, "queued", 1, late), (33, "failed", 1, late)]  # at the end of the timeout, not yet late
    assert walked(job, events, 61)[2:] == [(60, "queued", 1, late)]
    assert walked(job, [K.Event(0, 0, "started", 1)], 11) == [(10, "failed", 1, late)]  # value: retries so far
    login = K.Throttle(window=100, block=50, most=2)
    events = [K.Event(at, i, kind, 0) for i, (at, kind) in enumerate([(0, "failed"), (100, "failed"), (150, "failed"), (160, "ok"), (199, "failed"), (200, "failed"), (210, "ok"), (211, "failed")])]
    assert [r[1:] for r in walked(login, events, None)] == [(1, False), (1, False), (2, False), (2, True), (2, True), (1, False), (0, False), (1, False)]


def test_batches_pass_a_key_on_and_ignore_events_without_key_or_time(spark):
    rows = [(1, i, float(i), "failed") for i in range(9)] + [(None, 20, 0.0, "failed"), (5, None, 3.0, None)]
    events = table(spark, rows).unionByName(spark.createDataFrame([(6, 1, None, "failed")], "key long, number long, ts timestamp, kind string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(map(tuple, K.over_batch(events, K.Throttle()).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, i, min(i + 1, 5), i >= 5) for i in range(9)] + [(5, 0, 0, False)]
    assert K.over_batch(events.limit(0), K.LostJobs(), 10**16).count() == 0


def test_first_of_key_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 12), (2, 1, 13)], "project_id long, idempotency_key long, job_id long").withColumn("queued_at", F.timestamp_seconds(F.col("job_id") + START))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = J.first_of_key_stream(stream, "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.job_id for r in spark.table("firsts").collect()) == [10, 12, 13]
