"""Keyed rules with timers: jobs whose heartbeat stops, and login throttling, each rule once for batches and streams.

A rule is a small machine over one key's events in order of time: ``step`` takes an event, ``due`` says when the state ends
by itself and ``expire`` what happens then. ``over_batch`` runs it over a table, ``over_stream`` over a stream:

* by the clock ``event``, events wait until the watermark has passed them and are then taken in order, however they arrived,
  so that a stream gives what a batch gives of the same events; a timer wakes the key when the watermark passes its next
  event or the end of its state, without another event of that key;
* by the clock ``arrival``, events are taken at once, in order within a batch only; timers still go by the watermark;
* by the clock ``processing``, they are taken at once too, and timers go by the wall clock; a state that nobody has touched
  for ``KEPT_MS`` is dropped by its time to live. Such a query runs until it is stopped, as its time never ends.

A key holds its state and the events that wait; both are gone when the state has ended. State lies in the query's
checkpoint: a restarted query goes on where it was. Streams need the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SECOND = 1_000_000
KEPT_MS = 24 * 3600 * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that timers need."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Event(NamedTuple):
    """What a rule sees of an event; at is in microseconds, number tells apart events of one time."""

    at: int
    number: int
    kind: str
    value: int


EVENT = "at long, number long, kind string, value long"


@dataclass(frozen=True)
class LostJobs:
    """A running job without heartbeat for longer than timeout goes back to the queue, or fails when its retries are used up.

    Events are started, heartbeat and ended (anything else ends a job too). A heartbeat counts for a running job only, so one
    that is lost stays so until it is started again. A job that ended or failed is forgotten: started again, it is new, and
    value says how many retries it has behind it. Rows: key, at (the end of the timeout), status, retry_count, error.
    """

    timeout: int = 60 * SECOND
    most_retries: int = 3

    state = "status string, last long, retries long"
    out = "at long, status string, retry_count long, error string"

    def step(self, state: tuple | None, e: Event) -> tuple[tuple | None, list[tuple]]:
        if e.kind == "started":
            return ("running", e.at, state[2] if state else e.value), []
        if e.kind == "heartbeat":
            return (("running", max(state[1], e.at), state[2]) if state and state[0] == "running" else state), []
        return None, []

    def due(self, state: tuple | None) -> int | None:
        return state[1] + self.timeout if state and state[0] == "running" else None

    def expire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        if state[2] < self.most_retries:
            return ("queued", at, state[2] + 1), [(at, "queued", state[2] + 1, "worker_heartbeat_timeout")]
        return None, [(at, "failed", state[2], "worker_heartbeat_timeout")]


@dataclass(frozen=True)
class Throttle:
    """A window opens at the first failure; enough failures in it block for a while; success or expiry clears.

    Events are failed or anything else (a success). Rows, one an event: key, number, failures, blocked.
    """

    window: int = 15 * 60 * SECOND
    block: int = 15 * 60 * SECOND
    most: int = 5

    state = "failures long, opened long, until long"
    out = "number long, failures long, blocked boolean"

    def step(self, state: tuple | None, e: Event) -> tuple[tuple | None, list[tuple]]:
        if state and state[2] is not None:  # an expired block has been cleared before
            return state, [(e.number, state[0], True)]
        if e.kind != "failed":
            return None, [(e.number, 0, False)]
        n, opened = (state[0] + 1, state[1]) if state else (1, e.at)
        return (n, opened, e.at + self.block if n >= self.most else None), [(e.number, n, False)]

    def due(self, state: tuple | None) -> int | None:
        if state is None:
            return None
        return (state[2] if state[2] is not None else state[1] + self.window) - 1  # the state holds up to, not at, its end

    def expire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return None, []


Rule = LostJobs | Throttle


def _names(rule: Rule) -> list[str]:
    return [part.split()[0] for part in rule.out.split(", ")]


def advanced(rule: Rule, state: tuple | None, events: Iterable[Event], now: int | None) -> Iterator[tuple[tuple | None, tuple | None]]:
    """(state, row) after every step of one key's ordered events and, if now is known, what is due before it; row may be None."""
    for e in events:
        due = rule.due(state)
        if due is not None and e.at > due:
            state, rows = rule.expire(state, due)
            yield from ((state, r) for r in rows)
        state, rows = rule.step(state, e)
        yield from ((state, r) for r in rows)
    due = rule.due(state)
    if due is not None and now is not None and now > due:
        state, rows = rule.expire(state, due)
        yield from ((state, r) for r in rows)
    yield state, None


def _known(events: DataFrame) -> DataFrame:
    """key, number, kind, value and at of events(key, number, ts, kind and perhaps value); those without a key or time are no events."""
    value = F.col("value").cast("long") if "value" in events.columns else F.lit(0).cast("long")
    known = events.filter("key is not null and ts is not null")
    ts = F.col("ts").cast("timestamp")
    return known.select("key", ts.alias("ts"), F.unix_micros(ts).alias("at"), F.coalesce(F.col("number").cast("long"), F.lit(0).cast("long")).alias("number"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce(value, F.lit(0).cast("long")).alias("value"))


def over_batch(events: DataFrame, rule: Rule, now: int | None = None) -> DataFrame:
    """The rule's rows over a whole table of events; now (microseconds) says how far time has gone after the last event.

    Keys are dealt over tasks and their events sorted; a task streams them and holds one key's state, however many they are.
    """
    kind = dict(events.dtypes)["key"]
    names = _names(rule)
    ordered = _known(events).drop("ts").repartition("key").sortWithinPartitions("key", "at", "number")
    schema = f"key {kind}, {rule.out}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def ended() -> None:
            out.extend((key, *row) for _, row in advanced(rule, state, (), now) if row)

        for batch in batches:
            keys, rows = batch.column("key").to_pylist(), zip(*(batch.column(c).to_pylist() for c in Event._fields), strict=True)
            for k, row in zip(keys, rows, strict=True):
                if k != key:
                    ended()
                    key, state = k, None
                for state, made in advanced(rule, state, (Event(*row),), None):  # noqa: B007
                    if made:
                        out.append((key, *made))
            yield shaped(out)
            out.clear()
        ended()
        yield shaped(out)

    def shaped(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * (1 + len(names))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", *names])

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[kind], *(kinds[part.split()[1]] for part in rule.out.split(", "))]
    return ordered.mapInArrow(work, schema)


class _Keyed(StatefulProcessor):
    def __init__(self, rule: Rule, clock: str):
        self.rule, self.clock, self.row = rule, clock, Row("key", *_names(rule))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = {"ttlDurationMs": KEPT_MS} if self.clock == "processing" else {}
        self.state = handle.getValueState("state", self.rule.state, **kept)
        self.waiting = handle.getListState("waiting", EVENT, **kept)

    def _take(self, key: tuple, events: list[Event], now: int) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        state = before = tuple(before) if before else None
        for state, row in advanced(self.rule, state, sorted(events), now):  # noqa: B007
            if row:
                yield self.row(*key, *row)
        if state is None and before is not None:
            self.state.clear()
        elif state is not None and state != before:
            self.state.update(state)
        self._wake(self.rule.due(state))

    def _now(self, timers: TimerValues) -> int:
        return 1000 * (timers.getCurrentProcessingTimeInMs() if self.clock == "processing" else timers.getCurrentWatermarkInMs())

    def _wake(self, at: int | None) -> None:
        """A timer just after a time in microseconds."""
        if at is not None:
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = [Event(r.at, r.number, r.kind, r.value) for r in rows]
        if self.clock != "event":
            yield from self._take(key, events, self._now(timerValues))
        else:
            self.waiting.appendList([tuple(e) for e in events])
            self._wake(min(events).at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = self._now(timerValues)
        waiting = [Event(*e) for e in self.waiting.get()] if self.waiting.exists() else []
        later = sorted(e for e in waiting if e.at > now)
        if len(later) < len(waiting):
            self.waiting.put([tuple(e) for e in later]) if later else self.waiting.clear()
        yield from self._take(key, [e for e in waiting if e.at <= now], now)
        if later:
            self._wake(later[0].at)

    def close(self) -> None:
        pass


def over_stream(events: DataFrame, rule: Rule, clock: str = "event", lateness: str = "10 minutes") -> DataFrame:
    """The rule's rows over a stream, appended; but by the clock processing, events more than lateness behind the latest are dropped."""
    if clock not in ("event", "arrival", "processing"):
        raise ValueError(f"no such clock: {clock}")
    known = _known(events)
    known = known if clock == "processing" else known.withWatermark("ts", lateness)
    schema = f"key {dict(events.dtypes)['key']}, {rule.out}"
    return known.groupBy("key").transformWithState(_Keyed(rule, clock), schema, "append", "ProcessingTime" if clock == "processing" else "EventTime")
