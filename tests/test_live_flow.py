"""The driver's side against the cases the engine promises: cancellation, deadlines, breakers, limiters, streams, batches, logs, schedules."""

import json
import sqlite3
import threading
import time
from datetime import UTC, datetime, timedelta

import pytest

from weirflow.flow import graph, resilience, schedule, stages, store, testing
from weirflow.flow.errors import (
    AttemptTimeout, Cancelled, CheckpointConflict, CircuitOpen, CompensationFailed, ConfigurationError, FlowError, OrphanedCompensation, RateLimited, RetryExhausted, StateError, WorkflowTimeout,
)
from weirflow.flow.log import CURSOR, FileLog, MemoryLog, Row, SqlLog
from weirflow.flow.observe import ENGINE, HOOKS, Metrics, MetricsObserver, RecordingObserver, TracingObserver
from weirflow.flow.race import Cancel, race


def flow(**how):
    w = graph.Workflow(**how)
    seen = RecordingObserver()
    return w.observe(seen), seen


def later(f, seconds=0.05):
    t = threading.Timer(seconds, f)
    t.daemon = True
    t.start()


def hang(*_):
    time.sleep(5)
    return "end"


# --- cancellation ------------------------------------------------------------------------------


def test_a_cancelled_token_runs_nothing():
    w, seen = flow()
    calls, token = [], Cancel()
    token.cancel()
    token.cancel()
    with pytest.raises(Cancelled) as e:
        w.stage("a", calls.append).exit("end").run("a", cancel=token)
    assert not calls and e.value.category == "cancelled" and e.value.outer_category == "state" and e.value.attempt == 0 and seen.count("cancelled") == 1


@pytest.mark.parametrize("kind", ["single", "router", "poll", "timer", "batch", "stepped", "split", "stream"])
def test_cancelling_interrupts(kind):
    w, seen = flow()
    {
        "single": lambda: w.stage("s", hang),
        "router": lambda: w.router("s", hang),
        "poll": lambda: w.poll("s", lambda c: ("pending", 0.02)),
        "timer": lambda: w.timer("s", lambda c: 5.0, lambda c: "end"),
        "batch": lambda: w.batch("s", stages.Batch(lambda c: range(3), hang, lambda c, slots: "end", 2)),
        "stepped": lambda: w.stepped("s", lambda c, cursor: (time.sleep(0.01), ("more", 1))[1]),
        "split": lambda: w.split("s", [hang, hang], "end"),
        "stream": lambda: w.stream("s", stages.Stream(lambda c, cursor: slow_items(), lambda i: (i, i), lambda c, o: None, lambda c, reason: "end", stages.Count(100))),
    }[kind]()
    token, began = Cancel(), time.monotonic()
    later(token.cancel)
    with pytest.raises(Cancelled):
        w.exit("end").run("s", cancel=token)
    assert time.monotonic() - began < 2 and seen.count("cancelled") == 1


def slow_items():
    for i in range(1000):
        yield i
        time.sleep(0.01)


def test_a_compensatable_stage_is_not_interrupted_and_is_undone():
    w, _ = flow()
    token, undone, ended = Cancel(), [], []

    def slow(c):
        later(token.cancel, 0.02)
        time.sleep(0.15)
        ended.append(1)
        return "b", "out"

    with pytest.raises(Cancelled):
        w.compensated("a", slow, undone.append).stage("b", hang).exit("end").run("a", cancel=token)
    assert ended == [1] and undone == ["out"] and w.log.load("run") == []


def test_cancelling_with_a_failing_undo_is_a_failed_compensation():
    w, _ = flow()
    token = Cancel()
    later(token.cancel)
    w.compensated("a", lambda c: ("b", 1), lambda o: 1 / 0).stage("b", hang).exit("end")
    with pytest.raises(CompensationFailed) as e:
        w.run("a", cancel=token)
    assert isinstance(e.value.errors[0], Cancelled) and w.log.load("run")


def test_cancelling_comes_before_the_deadline_and_tears_resources_down():
    events = []
    held = store.Resources({"r": testing.CountedResource("r", events)})
    w, seen = flow(timeout=0.05, resources=held)
    token = Cancel()
    w.stage("a", lambda c: (time.sleep(0.02), token.cancel(), time.sleep(0.1), "end")[-1]).exit("end")
    with pytest.raises(Cancelled):
        w.run("a", cancel=token)
    assert events == ["up r", "down r"] and seen.count("workflow_timeout") == 0


def test_an_unused_token_changes_nothing():
    w, seen = flow()
    assert w.stage("a", lambda c: "end").exit("end").run("a", cancel=Cancel()) == "end" and seen.count("cancelled") == 0


def test_spark_jobs_of_what_is_left_behind_are_cancelled(spark):
    token = Cancel()

    def job():
        return spark.sparkContext.parallelize(range(4), 4).map(lambda x: time.sleep(30)).count()

    began = time.monotonic()
    later(token.cancel, 1.5)
    with pytest.raises(Cancelled):
        race(job, None, token)
    for _ in range(60):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() - began < 20
    assert spark.range(3).count() == 3


# --- timeouts ------------------------------------------------------------------------------------


def test_attempt_timeout_is_a_failed_attempt():
    calls = []

    def slow_once(c):
        calls.append(1)
        if len(calls) == 1:
            time.sleep(1)
        return "end"

    w, seen = flow()
    assert w.stage("a", slow_once, retry=resilience.Retry.fixed(1, 0), attempt_timeout=0.1).exit("end").run("a") == "end"
    assert len(calls) == 2 and seen.count("retry") == 1
    with pytest.raises(RetryExhausted) as e:
        resilience.with_retries(lambda: time.sleep(1), resilience.Retry.fixed(1, 0), attempt_timeout=0.05)
    assert isinstance(e.value.source, AttemptTimeout) and e.value.attempts == 2
    with pytest.raises(AttemptTimeout):
        resilience.run_task(lambda: time.sleep(1), resilience.TaskConfig(resilience.Retry.none(), 0.05))


@pytest.mark.parametrize("kind", ["single", "poll", "timer", "stream"])
def test_total_timeout_interrupts(kind):
    w, seen = flow(timeout=0.15)
    flushed = []
    {
        "single": lambda: w.stage("s", hang),
        "poll": lambda: w.poll("s", lambda c: ("pending", 0.02)),
        "timer": lambda: w.timer("s", lambda c: 5.0, lambda c: "end"),
        "stream": lambda: w.stream("s", stages.Stream(lambda c, cursor: slow_items(), lambda i: (i, i), lambda c, o: flushed.append(o), lambda c, reason: "end", stages.Count(1000))),
    }[kind]()
    began = time.monotonic()
    with pytest.raises(WorkflowTimeout) as e:
        w.exit("end").run("s")
    assert time.monotonic() - began < 2 and e.value.category == "workflow_timeout" and seen.count("workflow_timeout") == 1
    if kind == "stream":  # what the window held is flushed and committed
        assert flushed and w.log.load("run")[-1].kind == CURSOR


def test_rollback_has_a_deadline():
    w, _ = flow(timeout=10, compensation_timeout=0.1)
    undone = []
    w.compensated("a", lambda c: ("b", 1), undone.append).compensated("b", lambda c: ("c", 2), lambda o: time.sleep(1)).stage("c", lambda c: 1 / 0).exit("end")
    with pytest.raises(CompensationFailed) as e:
        w.run("a")
    kinds = [type(x) for x in e.value.errors]
    assert kinds == [StateError, AttemptTimeout, OrphanedCompensation, AttemptTimeout] and not undone


def test_an_output_that_cannot_be_logged_is_undone_at_once():
    undone = []
    w, _ = flow()
    with pytest.raises(StateError):
        w.compensated("a", lambda c: ("end", {1, 2}), undone.append).exit("end").run("a")
    assert undone == [{1, 2}]
    w.compensated("a", lambda c: (["x", "y"], 5), undone.append)
    with pytest.raises(StateError):
        w.run("a", run_id="second")
    assert undone[1:] == [5]


def test_a_split_result_is_refused():
    w, _ = flow()
    with pytest.raises(StateError, match="not a state"):
        w.stage("a", lambda c: ["b", "c"]).exit("end").run("a")


# --- breaker ------------------------------------------------------------------------------------------


def test_breaker_trials_epochs_and_dropped_permits():
    now = [0.0]
    b = resilience.Breaker(2, 10, lambda: now[0], trials=2)
    stale = b.acquire()
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    assert b.state == "open"
    now[0] = 10
    first, second = b.acquire(), b.acquire()
    assert b.state == "half_open"
    with pytest.raises(CircuitOpen):
        b.acquire()
    stale.success()  # of an earlier epoch
    assert b.state == "half_open"
    first.success()
    assert b.state == "half_open"
    second.success()
    assert b.state == "closed"
    for _ in range(2):
        p = b.acquire()
        del p  # dropped: failures
    assert b.state == "open"
    now[0] = 20
    b.acquire().failure()
    assert b.state == "open" and resilience.Breaker().trials == 1


def test_live_breaker_and_limiters_equal_the_folds():
    import random

    from weirflow.operators import folds

    rng, now = random.Random(3), [0]
    b, step, state = resilience.Breaker(2, 5, lambda: now[0]), folds.breaker_step(2, 5), (folds.CLOSED, 0, 0)
    bucket, bstep = resilience.TokenBucket(3, 1, 8, clock=lambda: now[0]), folds.bucket_step(3, 8)
    at = 0
    bstate, _ = bstep(None, 0, 0)
    for _ in range(400):
        at += rng.randrange(4)
        now[0] = at
        failed, cost = rng.random() < 0.5, rng.randrange(4)
        state, (admitted, mode) = step(state, at, failed)
        try:
            p = b.acquire()
            p.failure() if failed else p.success()
            assert admitted
        except CircuitOpen:
            assert not admitted
        assert b.state == mode
        bstate, (ok, _) = bstep(bstate, at, cost)
        assert bucket.try_acquire(cost) == ok


def test_an_open_breaker_ends_the_attempts():
    b = resilience.Breaker(1, 60)
    w, seen = flow()
    w.stage("a", lambda c: 1 / 0, retry=resilience.Retry.fixed(3, 0), breaker=b).exit("end")
    with pytest.raises(StateError) as e:
        w.run("a")
    assert e.value.category == "circuit_open" and e.value.attempt == 0 and seen.count("circuit_open") == 1


# --- limiters --------------------------------------------------------------------------------------------


def test_limiters_reserve_refund_and_wait():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = resilience.TokenBucket(2, 1, 1.0, burst=1, clock=lambda: now[0], sleep=sleep)
    assert t.available() == 3 and t.try_acquire(0) and not t.try_acquire(4) and t.time_until(4) == float("inf")
    with t.reserve(2) as r:
        assert t.available() == 1
    assert t.available() == 3
    r = t.reserve(3)
    r.commit()
    del r
    assert t.available() == 0 and t.time_until(2) == 2.0
    t.acquire(2)
    assert slept == [2.0]
    with pytest.raises(ConfigurationError):
        t.acquire(4)
    w = resilience.FixedWindow(2, 10, lambda: now[0], sleep)
    held = w.reserve(2)
    assert (w.used(), w.remaining(), w.try_acquire()) == (2, 0, False) and w.snapshot().available_in == 10
    now[0] += 10
    assert w.try_acquire(1)
    held.refund()  # of a window that is over
    assert w.used() == 1


def test_multi_limiter_is_all_or_nothing():
    now = [0.0]
    calls, tokens = resilience.FixedWindow(2, 10, lambda: now[0]), resilience.TokenBucket(5, 1, 1.0, clock=lambda: now[0])
    m = resilience.MultiLimiter(sleep=lambda s: now.__setitem__(0, now[0] + s)).tier("tokens", tokens, 3).tier("calls", calls, 1).tier("free", calls, 0)
    m.try_acquire()
    with pytest.raises(RateLimited) as e:
        m.try_acquire()
    assert (e.value.tier, e.value.retry_after) == ("tokens", 1.0) and calls.used() == 1
    m.try_acquire(["calls"])
    with pytest.raises(RateLimited) as e:
        m.try_acquire(["calls", "free"])
    assert e.value.tier == "calls" and tokens.available() == 2
    m.acquire()
    assert now[0] == 10 and calls.used() == 1


# --- batches, polls, timers ----------------------------------------------------------------------------------


def test_batch_slots_keep_their_order_and_errors():
    attempts, most, lock, now = {}, [0], threading.Lock(), [0]

    def work(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            attempts[i] = attempts.get(i, 0) + 1
        time.sleep(0.003 * (i % 3))
        with lock:
            now[0] -= 1
        if i == 7 or (i == 4 and attempts[i] < 3):
            raise ValueError(i)
        return i * 10

    got = []
    b = stages.Batch(lambda c: range(12), work, lambda c, slots: got.extend(slots) or "end", 3, resilience.Retry.fixed(2, 0))
    w, _ = flow()
    assert w.batch("b", b).exit("end").run("b") == "end"
    assert [s.value if s.ok else None for s in got] == [None if i == 7 else i * 10 for i in range(12)]
    assert attempts == {i: 3 if i in (4, 7) else 1 for i in range(12)} and most[0] <= 3
    assert sum(s.value for s in stages.Batch(lambda c: [1, 2, 3, 4, 5], lambda i: i * 2, None)._slots([1, 2, 3, 4, 5], None)) == 30


def test_a_batch_cycle_is_tried_again_when_finishing_fails():
    loads = []
    finish = testing.FailOn(lambda c, slots: "end", 1)
    w, _ = flow()
    assert w.batch("b", stages.Batch(lambda c: loads.append(1) or [1], lambda i: i, finish), retry=resilience.Retry.fixed(1, 0)).exit("end").run("b") == "end"
    assert len(loads) == 2


def test_poll_error_budget_counts_errors_in_a_row():
    answers = iter([ValueError(), ValueError(), ("pending", 0), ValueError(), ValueError(), ("ready", "end")])

    def ask():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert graph.poll(ask, 2, sleep=lambda s: None) == "end"
    for most, n in ((0, 1), (2, 3)):
        f = testing.FailOn(lambda: ("ready", "x"), *range(1, 9))
        with pytest.raises(RuntimeError):
            graph.poll(f, most, sleep=lambda s: None)
        assert f.calls == n


def test_timers_fire_when_due():
    w, seen = flow()
    began = time.monotonic()
    w.timer("past", lambda c: datetime.now(UTC) - timedelta(hours=1), lambda c: "soon").timer("soon", lambda c: 0.05, lambda c: "end").exit("end")
    assert w.run("past") == "end" and 0.05 <= time.monotonic() - began < 2
    testing.assert_path(seen, "past", "soon", "end")


# --- streams -------------------------------------------------------------------------------------------------------


def numbers(upto, flushed, closed=None, window=None, on_error="fail_fast", fails=lambda i: False, after=None):
    def process(i):
        if fails(i):
            raise ValueError(i)
        return i, i

    return stages.Stream(
        lambda c, cursor: iter(range((cursor or 0) + 1, upto + 1)), process, lambda c, out: flushed.append(out) or (after(out) if after else None),
        lambda c, reason: closed.append(reason) or "end" if closed is not None else "end", window or stages.Count(3), on_error,
    )


def test_stream_windows_tail_and_resume():
    flushed, failing = [], [True]
    w, _ = flow()
    w.stream("s", numbers(10, flushed, fails=lambda i: i == 8 and failing[0])).exit("end")
    with pytest.raises(StateError):
        w.run("s")
    assert flushed == [[1, 2, 3], [4, 5, 6]] and json.loads(w.log.load("run")[-1].blob) == 6
    failing[0] = False
    assert w.resume("run") == "end" and flushed[2:] == [[7, 8, 9], [10]]


def test_stream_policies():
    flushed = []
    assert stages.drive(numbers(5, flushed, window=stages.Count(2), on_error="skip", fails=lambda i: i == 2)) == "end" and flushed == [[1, 3], [4, 5]]
    flushed.clear()
    bad = numbers(9, flushed, on_error=2, fails=lambda i: i in (2, 3, 5, 6))
    assert stages.drive(bad) == "end" and flushed == [[1, 4, 7], [8, 9]]
    with pytest.raises(ValueError):
        stages.drive(numbers(9, [], on_error=1, fails=lambda i: i in (4, 5)))
    slow = numbers(3, flushed, on_error="skip")
    slow.process, slow.attempt_timeout = lambda i: (time.sleep(1 if i == 2 else 0), (i, i))[1], 0.2
    flushed.clear()
    assert stages.drive(slow) == "end" and flushed == [[1, 3]]


def test_stream_stop_commits_and_does_not_close():
    flushed, closed, commits = [], [], []
    s = numbers(4, flushed, closed, stages.Count(1), after=lambda out: stages.Stop("enough"))
    assert stages.drive(s, commit=commits.append) == "enough" and flushed == [[1]] and closed == [] and commits == [1]
    s = numbers(2, flushed, closed, stages.Count(5), after=lambda out: stages.Stop("tail"))
    assert stages.drive(s, commit=commits.append) == "tail" and commits == [1, 2]


def test_cancelled_stream_flushes_and_commits():
    flushed, closed, token = [], [], Cancel()
    w, _ = flow()

    def items(c, cursor):
        yield from (1, 2, 3, 4)
        time.sleep(2)

    def process(i):
        if i == 4:
            token.cancel()
        return i, i

    s = numbers(0, flushed, closed, stages.Count(3), after=lambda out: stages.Stop("ignored") if len(out) == 1 else None)
    s.open, s.process = items, process
    with pytest.raises(Cancelled):
        w.stream("s", s).exit("end", "ignored").run("s", cancel=token)
    assert flushed == [[1, 2, 3], [4]] and closed == ["cancelled"]
    assert [json.loads(r.blob) for r in w.log.load("run") if r.kind == CURSOR] == [3, 4]
    # A drain whose flush fails commits nothing.
    w, _ = flow()
    token = Cancel()
    s.flush = lambda c, out: 1 / 0 if len(out) == 1 else None
    with pytest.raises(StateError):
        w.stream("s", s).exit("end").run("s", cancel=token)
    assert [json.loads(r.blob) for r in w.log.load("run") if r.kind == CURSOR] == [3]


def test_duration_windows_are_not_flushed_empty():
    flushed = []

    def items(c, cursor):
        yield 1
        yield 2
        time.sleep(0.5)
        yield 3

    s = numbers(0, flushed, window=stages.Duration(0.1))
    s.open = items
    assert stages.drive(s) == "end" and flushed == [[1, 2], [3]]


def test_hysteresis_switches_the_window():
    readings, alert, flushed, token = [70, 71, 73, 85, 88, 76, 71, 90, 68, 73, 74, 95, 88, 60], [False], [], None

    def flush(c, out):
        flushed.append(("alert" if alert[0] else "calm", out))
        if alert[0]:
            alert[0] = not max(out) <= 70
        else:
            alert[0] = max(out) >= 80

    s = stages.Stream(lambda c, cursor: iter(readings), lambda t: (t, t), flush, lambda c, r: "done", lambda: stages.Count(1 if alert[0] else 3))
    assert stages.drive(s) == "done"
    assert flushed == [("calm", [70, 71, 73]), ("calm", [85, 88, 76]), ("alert", [71]), ("alert", [90]), ("alert", [68]), ("calm", [73, 74, 95]), ("alert", [88]), ("alert", [60])]


# --- logs -------------------------------------------------------------------------------------------------------------


@pytest.fixture(params=["memory", "file", "sql"])
def log(request, spark, tmp_path):
    return {"memory": MemoryLog, "file": lambda: FileLog(spark, str(tmp_path / "log")), "sql": lambda: SqlLog(lambda: sqlite3.connect(tmp_path / "log.db", timeout=30)).create()}[request.param]()


def test_two_writers_of_one_sequence_number(log):
    results, start = [], threading.Barrier(4)

    def write(k):
        start.wait()
        try:
            log.append("run/1", Row(0, f"s{k}", "t", 1, "{}", 2))
            results.append("ok")
        except CheckpointConflict:
            results.append("conflict")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(results) == ["conflict"] * 3 + ["ok"] and len(log.load("run/1")) == 1
    for n in (3, 1, 2):
        log.append("run/1", Row(n, "x", "t"))
    assert [r.sequence for r in log.load("run/1")] == [0, 1, 2, 3] and log.load("other") == []
    assert log.load("run/1")[0].blob == "{}" and log.load("run/1")[0].workflow_version == 2
    log.clear("run/1")
    assert log.load("run/1") == []


def test_a_run_goes_on_from_any_log(log):
    w, seen = flow(log=log)
    undone = []
    fail = testing.FailOn(lambda c: "end", 1, 2)
    w.compensated("a", lambda c: ("b", {"n": 1}), undone.append).stage("b", fail).exit("end")
    w.compensated("a", lambda c: ("b", {"n": 1}), testing.FailOn(undone.append, 1))
    with pytest.raises(CompensationFailed):
        w.run("a")
    assert [r.kind for r in log.load("run")] == [0, 1, 0]
    with pytest.raises(StateError):
        w.resume("run")
    assert undone == [{"n": 1}] and log.load("run") == [] and seen.count("resume") == 1


def test_a_log_of_another_version_is_refused():
    log = MemoryLog()
    log.append("run", Row(0, "a", "a", 0, None, 1))
    with pytest.raises(ConfigurationError, match="version"):
        graph.Workflow(log, version=2).stage("a", lambda c: "end").exit("end").resume("run")


def test_appends_that_fail_and_logs_that_stay():
    undone = []
    w, _ = flow(log=testing.FailingLog(1))
    with pytest.raises(StateError) as e:
        w.compensated("a", lambda c: ("end", 3), undone.append).exit("end").run("a")
    assert e.value.category == "checkpoint_store" and undone == [3]
    w, seen = flow(log=testing.FailingLog(clear=False))
    assert w.stage("a", lambda c: "end").exit("end").run("a") == "end" and seen.count("checkpoint_clear_failed") == 1


def test_rows_of_states_that_are_gone_are_told():
    log = MemoryLog()
    for n, s in enumerate(("gone", "a")):
        log.append("run", Row(n, s, s))
    w, seen = flow(log=log)
    assert w.stage("a", lambda c: "end").exit("end").resume("run") == "end" and seen.count("unknown_resume_state") == 1


# --- splits ------------------------------------------------------------------------------------------------------------


def test_split_timeouts_bulkhead_and_messages():
    w, _ = flow()
    began = time.monotonic()
    with pytest.raises(StateError, match="Split task timeout exceeded"):
        w.split("s", [lambda c: 1, hang], "end", timeout=0.1).exit("end").run("s")
    assert w.split("s", [lambda c: 1, hang], "end", "partial_timeout", timeout=0.1).run("s", run_id="2") == "end"
    assert w.split("s", [lambda c: 1, hang], "end", "any").run("s", run_id="3") == "end" and time.monotonic() - began < 3
    with pytest.raises(StateError) as e:
        w.split("s", [lambda c, i=i: [][i] for i in range(5)], "end").run("s", run_id="4")
    assert str(e.value).count("list index") == 3
    most, now, lock = [0], [0], threading.Lock()

    def branch(c):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1

    assert w.split("s", [branch] * 8, "end", bulkhead=2).run("s", run_id="5") == "end" and most[0] <= 2
    assert w.split("s", [], "end", "all").run("s", run_id="6") == "end"
    with pytest.raises(StateError):
        w.split("s", [], "end", "any").run("s", run_id="7")


# --- schedules -----------------------------------------------------------------------------------------------------------


def test_scheduler_runs_cancels_and_stops():
    events, ran = [], []
    held = store.Resources({"r": testing.CountedResource("r", events)})
    w, _ = flow()
    w.stage("a", hang).exit("end")
    sched = schedule.Scheduler(held).every("tick", lambda: ran.append(1), 0.05).manual("long", lambda cancel: w.run("a", cancel=cancel)).manual("bad", lambda: 1 / 0, limit=2, initial=0.01)
    with pytest.raises(ConfigurationError):
        sched.manual("bad", hang)
    r = sched.start()
    r.trigger("long")
    with pytest.raises(FlowError, match="already running"):
        r.trigger("long")
    with pytest.raises(FlowError, match="no flow"):
        r.trigger("none")
    time.sleep(0.3)
    assert len(ran) >= 3 and r.has_running() and set(r.list()) == {"tick", "long", "bad"}
    r.cancel("long")
    wait(lambda: r.status("long").name == "idle")
    assert r.status("long").streak == 0
    for _ in range(2):
        r.trigger("bad")
        wait(lambda: r.status("bad").name in ("backoff", "tripped"))
        time.sleep(0.02)
    assert r.status("bad").name == "tripped" and r.status("bad").streak == 2 and "zero" in r.status("bad").last_error
    with pytest.raises(FlowError, match="tripped"):
        r.trigger("bad")
    r.reset("bad")
    assert r.status("bad").name == "idle"
    r.trigger("long")
    r.stop(5)
    assert not r.has_running() and events == ["up r", "down r"] and r.wait(0.1)
    with pytest.raises(FlowError):
        r.trigger("long")


def wait(f, seconds=5):
    ends = time.monotonic() + seconds
    while not f() and time.monotonic() < ends:
        time.sleep(0.01)
    assert f()


def test_backoff_is_capped_again_after_jitter():
    b = schedule.Backoff(1, 2, 8, 0.5, 3)
    assert [b.delay(k, 0.0) for k in (1, 2, 3, 4, 9)] == [1, 2, 4, 8, 8] and b.delay(9, 1.0) == 8 and b.delay(1, -1.0) == 0.5
    assert not b.tripped(2) and b.tripped(3) and not schedule.Backoff().tripped(100)
    now = [0.0]
    f = schedule.Flow(lambda: 1 / 0, every=2, initial=10, clock=lambda: now[0])
    f.trigger()
    assert f.wait_s() == 10 and f.state().name == "backoff"
    now[0] = 9
    assert f.wait_s() == 2


def test_a_failed_set_up_tears_down_what_was_up():
    events = []
    held = store.Resources({"a": testing.CountedResource("a", events), "b": testing.CountedResource("b", events, fails=True)})
    with pytest.raises(RuntimeError):
        schedule.Scheduler(held).start()
    assert events == ["up a", "down a"]


# --- observers ---------------------------------------------------------------------------------------------------------------


def test_observers_hear_in_order_and_never_stop_a_run(caplog):
    class Bad(MetricsObserver):
        def on_state_enter(self, state):
            raise RuntimeError

    w, seen = flow()
    metrics = MetricsObserver()
    w.observe(Bad()).observe(metrics).observe(TracingObserver())
    with caplog.at_level("INFO", "weirflow"):
        assert w.stage("a", testing.FailOn(lambda c: "end", 1), retry=resilience.Retry.fixed(1, 0)).exit("end").run("a") == "end"
    assert [e[0] for e in seen.events] == ["state_enter", "checkpoint", "task_start", "retry", "task_success", "state_enter", "checkpoint"]
    rows = {(n, label): total for _, n, label, _, total in metrics.metrics.rows()}
    assert rows["task_retries_total", "a"] == 1 and rows["observed_task_runs_total", "success"] == 1 and "state_enter ('a',)" in caplog.text
    assert len(HOOKS) == 12 and ENGINE.counters["workflow_runs_total", "completed"] > 0


def test_metrics_as_a_table(spark):
    m = Metrics()
    m.add("runs", "ok", 2)
    m.observe("seconds", 1.5)
    m.observe("seconds", 2.5)
    m.gauge("active", 1)
    assert [tuple(r) for r in m.frame(spark).orderBy("name").collect()] == [("gauge", "active", "", 1.0, 1.0), ("counter", "runs", "ok", 2.0, 2.0), ("histogram", "seconds", "", 2.0, 4.0)]


def test_validation():
    with pytest.raises(ConfigurationError):
        graph.Workflow().validate()
    with pytest.raises(ConfigurationError, match="unknown state"):
        graph.Workflow().split("s", [hang], "nowhere").exit("end").validate("s")
    with pytest.raises(ConfigurationError, match="no state"):
        graph.Workflow().stage("a", hang).exit("end").validate("b")
    for bad in ("* * * * *", "61 * * * * *", "* * 25 * * *"):
        with pytest.raises(ConfigurationError):
            schedule.Scheduler().cron("c", hang, bad)


def test_decorated_stages():
    w, seen = flow()

    @w.on("way", "router")
    def way(c):
        return "work"

    @w.on("work", retry=resilience.Retry.fixed(1, 0))
    def work(c):
        return "end"

    assert w.exit("end").run("way") == "end" and work(None) == "end"
    testing.assert_path(seen, "way", "work", "end")
    with pytest.raises(ConfigurationError):
        w.on("x", "stream")


def test_resources_by_kind_and_their_health():
    events = []

    class Mute:
        def health(self):
            raise OSError

    held = store.Resources({"a": testing.CountedResource("a", events, health="degraded"), "b": testing.CountedResource("b", events, health="degraded")})
    assert held.worst() == ("a", "degraded") and held.get("a", testing.CountedResource).name == "a"
    held.insert("c", Mute())
    assert held.check() == {"a": "degraded", "b": "degraded", "c": "unhealthy"} and held.health() == "unhealthy"
    for wrong in (("d", None), ("a", int)):
        with pytest.raises(ConfigurationError):
            held.get(*wrong)
    with pytest.raises(ConfigurationError):
        held.insert("a", 1)


@pytest.mark.parametrize("failing", range(4))
def test_a_failure_at_any_step_undoes_what_was_done(failing):
    """Exhaustive: whichever stage fails, the completed ones before it are undone, last first, and the log is cleared."""
    w, _ = flow()
    undone = []
    for k in range(4):
        w.compensated(f"s{k}", (lambda c: 1 / 0) if k == failing else (lambda c, k=k: (f"s{k + 1}", k)), undone.append)
    w.exit("s4")
    with pytest.raises(StateError) as e:
        w.run("s0")
    assert e.value.state == f"s{failing}" and undone == list(range(failing))[::-1]
    assert (w.log.load("run") == []) == (failing > 0)  # with nothing to undo, the log is kept
