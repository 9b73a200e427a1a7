"""The life of jobs as a stream: the same rows for every cut into batches, after a stop, and as a plain fold gives."""

import datetime as dt
import random

import pytest

from lectern.streaming import jobs as L

SCHEMA = "job_id long, at timestamp, event_id long, action string, share double, key string"
ACTIONS = ["start", "read", "mapped", "confirm", "start", "checked", "progress", "fail", "restart", "retry", "cancel", "odd"]
HOUR = 3_600_000


def events(n=240, jobs=4, seed=1, jitter=1_200_000):
    """(job, time in ms, id, action, share) in the order in which they come: at most ``jitter`` out of order. The last one moves the watermark far."""
    rng, at, out = random.Random(seed), 10 * HOUR, []
    for k in range(n):
        at += rng.choice([1, 1000, 60_000, HOUR, 3 * HOUR, 9 * HOUR]) // 4
        out.append((rng.randrange(jobs), at, k, rng.choice(ACTIONS), rng.random() if k % 3 else None))
    order = sorted(out, key=lambda e: e[1] + rng.randrange(jitter))
    return [*order, (99, at + 40 * HOUR, n, "start", None)]


def frame(spark, rows):
    stamp = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
    return spark.createDataFrame([(j, None if a is None else stamp(a), e, act, s, "x") for j, a, e, act, s in rows], SCHEMA).coalesce(1)


def streamed(spark, folder, batches, runs=1):
    """The rows of a stream over the batches; in several runs, each going on where the last one stopped."""
    out = []
    for r in range(runs):
        for b in batches[r::runs] if runs == 1 else batches[len(batches) * r // runs : len(batches) * (r + 1) // runs]:
            frame(spark, b).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        L.run_to_end(spark, L.job_steps(stream), f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.schema(L.STEPS).parquet(f"{folder}/out").collect()
    return sorted(map(tuple, out), key=repr)


def cut(rows, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(rows[at : at + n])
        at += n
    return [*out, rows[at:]]


@pytest.mark.parametrize(("sizes", "runs"), [([], 1), ([3, 40, 1, 90], 1), ([60, 60, 60], 2)])
def test_any_cut_gives_the_plain_fold(spark, tmp_path, sizes, runs):
    rows = events()
    upto = rows[-1][1] - HOUR
    want = sorted(L.plain_steps([r for r in rows if r[1] < upto], upto), key=repr)
    assert {w[3] for w in want} >= {"time_out", "progress", "retry"} and {w[6] for w in want} == {True, False}
    assert streamed(spark, str(tmp_path), cut(rows, sizes), runs) == want


def test_nulls_repeats_and_late_events(spark, tmp_path):
    rows = [(1, 20 * HOUR, 1, "start", None), (1, 20 * HOUR, 1, "start", None), (None, 20 * HOUR, 2, "start", None), (1, None, 3, "read", None), (1, 20 * HOUR + 5, 4, None, None)]
    first, late = [*rows, (2, 30 * HOUR, 5, "start", None)], [(1, 20 * HOUR + 7, 6, "read", None), (2, 90 * HOUR, 7, "read", None)]
    got = streamed(spark, str(tmp_path), [first, [(3, 31 * HOUR, 8, "progress", 0.5)], late])
    want = [(1, 20 * HOUR, 1, "start", "extracting", 3, True), (1, 20 * HOUR + 5, 4, "", "extracting", 3, False), (1, 26 * HOUR + 5, None, "time_out", "failed", 100, True), (2, 30 * HOUR, 5, "start", "extracting", 3, True), (2, 36 * HOUR, None, "time_out", "failed", 100, True), (3, 31 * HOUR, 8, "progress", "queued", 0, False)]
    assert got == sorted(want, key=repr)


def test_moves():
    def run(*actions):
        job = L.Job()
        legal = [job.apply(k, *a) if isinstance(a, tuple) else job.apply(k, a, None) for k, a in enumerate(actions)]
        return job.state, job.progress, legal

    assert run("start", "read", ("progress", 0.5), "mapped", "confirm", "start", ("progress", 1.0), "checked") == ("completed", 100, [True] * 8)
    assert run("start", "read", "mapped", "confirm", "start", "fail", "retry") == ("queued_check", 32, [True] * 7)
    assert run("start", "fail", "retry") == ("queued", 0, [True] * 3)
    assert run("start", "read", "restart") == ("queued", 0, [True] * 3)
    assert run("start", "read", "mapped", "confirm", "restart") == ("queued_check", 32, [True] * 5)
    assert run("checked", ("progress", 0.5), "cancel", "start") == ("cancelled", 0, [False, False, True, False])


def test_a_cluster_must_name_its_folder(spark):
    from lectern.functions.folders import shared_folder

    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_events_go_to_the_state_together():
    class Waiting:
        calls, kept = 0, []

        def appendList(self, some):
            self.calls, self.kept = self.calls + 1, [*self.kept, *some]

        def get(self):
            self.calls += 1
            return iter(self.kept)

        def put(self, some):
            self.calls, self.kept = self.calls + 1, some

        def clear(self):
            self.calls, self.kept = self.calls + 1, []

    class Value:
        exists, update = lambda self: False, lambda self, x: None

    class Handle:
        timers = []
        getListState, getValueState = lambda self, *a: Waiting(), lambda self, *a: Value()
        listTimers, registerTimer, deleteTimer = lambda self: iter(self.timers), lambda self, t: self.timers.append(t), lambda self, t: self.timers.remove(t)

    class Now:
        getCurrentWatermarkInMs = lambda self: 1_000_000

    life = L.Life(6 * HOUR)
    life.init(Handle())
    rows = [L.Row(at_ms=1000 + k % 500, event_id=k % 500, action="start", share=None) for k in range(1000)] + [L.Row(at_ms=2_000_000, event_id=9999, action="read", share=None)]
    assert not list(life.handleInputRows((1,), iter(rows), Now()))
    assert len(list(life.handleExpiredTimer((1,), Now(), None))) == 500
    assert life.waiting.kept == [(2_000_000, 9999, "read", None)] and life.waiting.calls == 3
