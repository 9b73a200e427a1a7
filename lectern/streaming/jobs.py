"""The life of a job as a stream: events move it from state to state, and silence ends it.

Events of a job are applied in the order of their time, whatever the order in
which they come and however the stream is cut into batches: they wait in the
job's state until the watermark has passed them. Event-time timers say when, and
when a job that works has been silent for too long. So any cut gives the same
rows, and a stream that stops goes on from its checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.folders import shared_folder

#: What an action makes of a state: (state, progress) (fixed values).
MOVES = {
    ("queued", "start"): ("extracting", 3),
    ("extracting", "read"): ("mapping", 12),
    ("mapping", "mapped"): ("awaiting_review", 30),
    ("awaiting_review", "confirm"): ("queued_check", 32),
    ("queued_check", "start"): ("checking", 35),
    ("checking", "checked"): ("completed", 100),
    ("extracting", "fail"): ("failed", 100),
    ("mapping", "fail"): ("failed", 100),
    ("checking", "fail"): ("failed", 100),
    ("extracting", "restart"): ("queued", 0),
    ("mapping", "restart"): ("queued", 0),
    ("checking", "restart"): ("queued_check", 32),
    ("queued_check", "restart"): ("queued_check", 32),
}
#: States that work, and the progress at their start and behind it.
SPANS = {"mapping": (12, 18), "checking": (35, 63)}
WORKING = ("extracting", "mapping", "checking")
STEPS = "job_id long, at_ms long, event_id long, action string, state string, progress int, legal boolean"


class Job:
    """A job's state, and what an action makes of it. New jobs are queued."""

    def __init__(self, state: str = "queued", progress: int = 0, since: int = 0, read: bool = False, confirmed: bool = False):
        self.state, self.progress, self.since, self.read, self.confirmed = state, progress, since, read, confirmed

    def values(self) -> tuple:
        return self.state, self.progress, self.since, self.read, self.confirmed

    def silent_until(self, patience: int) -> int | None:
        """When silence ends the job; None if it doesn't work."""
        return self.since + patience if self.state in WORKING else None

    def time_out(self, at: int) -> None:
        self.state, self.progress, self.since = "failed", 100, at

    def apply(self, at: int, action: str, share: float | None) -> bool:
        """Whether the action was legal. An illegal one changes nothing, but it is a sign of life."""
        self.since = at
        if action == "cancel":
            self.state = "cancelled"
        elif action == "retry":
            again = self.read and self.confirmed
            self.state, self.progress = ("queued_check", 32) if again else ("queued", 0)
        elif action == "progress":
            if self.state not in SPANS or share is None:
                return False
            low, span = SPANS[self.state]
            self.progress = low + int(min(1.0, max(0.0, share)) * span + 0.5)
        elif (self.state, action) in MOVES:
            self.state, self.progress = MOVES[self.state, action]
            self.read |= action == "read"
            self.confirmed |= action == "confirm"
        else:
            return False
        return True


def steps(job: Job, job_id: int, events: list[tuple[int, int, str, float | None]], upto: int, patience: int) -> Iterator[Row]:
    """A row for each event (time, id, action, share), in order, and for each time-out before ``upto``."""
    for at, event_id, action, share in events:
        end = job.silent_until(patience)
        if end is not None and at > end:
            job.time_out(end)
            yield Row(job_id=job_id, at_ms=end, event_id=None, action="time_out", state=job.state, progress=job.progress, legal=True)
        legal = job.apply(at, action, share)
        yield Row(job_id=job_id, at_ms=at, event_id=event_id, action=action, state=job.state, progress=job.progress, legal=legal)
    end = job.silent_until(patience)
    if end is not None and end < upto:
        job.time_out(end)
        yield Row(job_id=job_id, at_ms=end, event_id=None, action="time_out", state=job.state, progress=job.progress, legal=True)


#: Events that go to a job's state in one call. A call is a round trip to the state store, so one for each event would take most of the time.
AT_ONCE = 10_000


class Life(StatefulProcessor):
    """Keeps a job's state, and the list of its events that the watermark hasn't passed yet; the next timer is for the first of these, or for silence."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, progress int, since long, read boolean, confirmed boolean")
        self.waiting = handle.getListState("events", "at long, event_id long, action string, share double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, some = None, []
        for r in rows:
            some.append((r.at_ms, r.event_id, r.action, r.share))
            first = r.at_ms if first is None else min(first, r.at_ms)
            if len(some) == AT_ONCE:
                self.waiting.appendList(some)
                some = []
        if some:
            self.waiting.appendList(some)
        if first is not None:
            self._wake(first + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        past, later = {}, []
        for event in self.waiting.get():
            if event[0] < now:
                past[event[:2]] = tuple(event)  # of one that repeats the last counts
            else:
                later.append(tuple(event))
        left = min((e[0] for e in later), default=None)
        if past and later:
            self.waiting.put(later)
        elif past:
            self.waiting.clear()
        job = Job(*self.job.get()) if self.job.exists() else Job()
        out = list(steps(job, key[0], sorted(past.values(), key=lambda e: e[:2]), now, self.patience))
        if out:
            self.job.update(job.values())
        end = job.silent_until(self.patience)
        wakes = [x + 1 for x in (left, end) if x is not None]
        if wakes:
            self._wake(max(min(wakes), now + 1), now)
        return iter(out)

    def _wake(self, at: int, now: int = -1) -> None:
        """The earliest time that is asked for is the job's only timer, but for the one that goes off ``now``."""
        before = [t for t in self.handle.listTimers() if t > now]
        if not before or at < min(before):
            for t in before:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def job_steps(events: DataFrame, late: str = "1 hour", patience: int = 6 * 3_600_000) -> DataFrame:
    """(job_id, at_ms, event_id, action, state, progress, legal) of every event of a stream, and of every time-out, once the watermark has passed it.

    ``events`` has job_id, at (a timestamp), event_id, action and share (of what is
    done, for ``progress``). Times count in milliseconds; events of one time go by
    their ids, and one that repeats counts once. Events that come later than
    ``late`` are left out. A job that works and is silent for more than
    ``patience`` milliseconds fails. Nulls: an event without job, time or id is
    left out; an unknown or null action is illegal.
    """
    rows = events.select("job_id", F.col("at").cast("timestamp").alias("at"), "event_id", F.coalesce("action", F.lit("")).alias("action"), F.col("share").cast("double").alias("share"))
    rows = rows.filter("job_id is not null and at is not null and event_id is not null").withWatermark("at", late)
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("job_id").transformWithState(Life(patience), STEPS, "Append", "EventTime")


#: The state stores of these streams: timers and maps need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there to read, into Parquet files under ``out``; a later run with the same checkpoint goes on from there."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)


def settled_steps(spark: SparkSession, stream: DataFrame, schema: str = STEPS) -> DataFrame:
    """The rows of a stream that is read to its end, from the shared folder that they are written to."""
    out = shared_folder(spark, "steps")
    run_to_end(spark, stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(schema).parquet(f"{out}/rows")


def plain_steps(events: list[tuple[int, int, int, str, float | None]], upto: int, patience: int = 6 * 3_600_000) -> list[tuple]:
    """The same rows for (job, time, id, action, share) tuples in memory, for a service's own small table."""
    out = []
    for job_id in sorted({e[0] for e in events}):
        own = sorted({e[1:3]: e[1:] for e in events if e[0] == job_id and e[1] < upto}.values(), key=lambda e: e[:2])
        out += [tuple(r) for r in steps(Job(), job_id, own, upto, patience)]
    return out


def watermark_ms(latest: dt.datetime, late_ms: int = 3_600_000) -> int:
    """Where the watermark stands when the latest event has been read."""
    return int(latest.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - late_ms
