from datetime import UTC, datetime

import pytest

from weirflow.flow import graph, resilience, schedule, store
from weirflow.flow.errors import CheckpointConflict, CircuitOpen, CompensationFailed, ConfigurationError, RetryExhausted, StateError
from weirflow.flow.log import MemoryLog, ParquetLog, Row


def test_graph_walks_routes_and_clears_its_log():
    w = graph.Workflow().stage("a", lambda c: "r").router("r", lambda c: "b").stage("b", lambda c: "end").exit("end")
    seen = []
    w.observers.append(lambda e, s: seen.append(s) if e == "enter" else None)
    assert w.run("a") == "end" and seen == ["a", "r", "b", "end"] and w.log.load("run") == []
    with pytest.raises(ConfigurationError):
        w.run("nowhere")


def test_rollback_is_last_first_and_reported():
    undone = []
    boom = lambda c: 1 / 0
    w = graph.Workflow().compensated("a", lambda c: ("b", 1), undone.append).compensated("b", lambda c: ("c", 2), undone.append).stage("c", boom).exit("end")
    with pytest.raises(StateError) as e:
        w.run("a")
    assert undone == [2, 1] and e.value.path == ["a", "b", "c"] and w.log.load("run") == []
    w.compensated("b", lambda c: ("c", 2), boom)
    with pytest.raises(CompensationFailed):
        w.run("a")
    assert w.log.load("run")


def test_stepped_stage_resumes_at_its_cursor():
    calls, fail = [], [True]

    def step(c, cursor):
        calls.append(cursor)
        at = (cursor or 0) + 1
        if at == 3 and fail[0]:
            raise RuntimeError
        return ("done", "end") if at == 4 else ("more", at)

    w = graph.Workflow().stepped("s", step).exit("end")
    with pytest.raises(StateError):
        w.run("s")
    fail[0] = False
    assert w.resume("run") == "end" and calls == [None, 1, 2, 2, 3]


@pytest.mark.parametrize(("strategy", "parameter", "ok"), [("all", 0, False), ("any", 0, True), ("quorum", 2, True), ("percentage", 0.9, False), ("partial_results", 2, True)])
def test_splits(strategy, parameter, ok):
    w = graph.Workflow().split("s", [lambda c: 1, lambda c: 1 / 0, lambda c: 3], "end", strategy, parameter).exit("end")
    if ok:
        assert w.run("s") == "end"
    else:
        with pytest.raises(StateError):
            w.run("s")


def test_retries_breaker_and_limiter():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok"

    assert resilience.with_retries(flaky, resilience.Retry.fixed(3, 0), sleep=lambda s: None) == "ok"
    with pytest.raises(RetryExhausted):
        resilience.with_retries(lambda: 1 / 0, resilience.Retry.fixed(1, 0), sleep=lambda s: None)
    assert [resilience.Retry(jitter=0).delay(k) for k in (0, 1, 20)] == [100, 200, 30_000]
    now = [0.0]
    b = resilience.Breaker(1, 10, lambda: now[0])
    with pytest.raises(ZeroDivisionError):
        b.call(lambda: 1 / 0)
    with pytest.raises(CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1 and b.state == "closed"
    from weirflow.operators.folds import bucket_step

    lim = resilience.Limiter(bucket_step(1, 1_000_000), lambda: now[0])
    assert lim.try_acquire() and not lim.try_acquire()


def test_logs_refuse_a_taken_sequence(spark, tmp_path):
    for log in (MemoryLog(), ParquetLog(spark, str(tmp_path))):
        log.append("r", Row(0, "a", "a"))
        log.append("r", Row(1, "b", "b", 2, "5"))
        with pytest.raises(CheckpointConflict):
            log.append("r", Row(1, "b", "b"))
        assert [(r.sequence, r.state) for r in log.load("r")] == [(0, "a"), (1, "b")]
        log.clear("r")
        assert log.load("r") == []


def test_schedule():
    at = datetime(2024, 2, 28, 23, 59, 30, tzinfo=UTC)
    assert schedule.next_cron("0 */15 * * * *", at) == datetime(2024, 2, 29, tzinfo=UTC)
    assert schedule.next_cron("5 0 12 1 * *", at) == datetime(2024, 3, 1, 12, 0, 5, tzinfo=UTC)
    f = schedule.Flow(lambda: 1 / 0, every=1, limit=2)
    assert f.trigger() and f.status == "backoff" and f.trigger() and f.status == "tripped" and not f.trigger()


def test_store_and_resources():
    s = store.Store()
    s.append("k", 1)
    s.append("k", 2)
    assert s.need("k") == [1, 2]
    s["v"] = 3
    with pytest.raises(Exception, match="no list"):
        s.append("v", 1)
    order = []

    class R:
        def __init__(self, n):
            self.n = n

        def setup(self):
            order.append(self.n)

        def teardown(self):
            order.append(-self.n)

    r = store.Resources()
    r.insert("a", R(1))
    r.insert("b", R(2))
    with r:
        pass
    assert order == [1, 2, -2, -1] and r.health() == "healthy"


@pytest.mark.parametrize("policy", ["skip", "fail_fast", 1])
@pytest.mark.parametrize("kind", ["count", "duration"])
def test_live_windows_equal_replay_and_go_on_after_a_restart(spark, tmp_path, kind, policy):
    """Two runs over the two halves of the events flush what one replay of all flushes, the tail included."""
    from pyspark.sql import functions as F

    from weirflow.flow.stages import Count, Duration
    from weirflow.functions.clock import micros
    from weirflow.operators import streams
    from weirflow.sources.tables import event_stream
    from weirflow.streaming import live

    day = 86_400_000_000
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 5").withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value"))).orderBy("event_id")
    half = src.approxQuantile("event_id", [0.5], 0.0)[0]
    path = [str(tmp_path / x) for x in ("in", "out", "cp")]
    for part in (src.where(F.col("event_id") <= half), src.where(F.col("event_id") > half)):
        part.coalesce(1).write.mode("append").parquet(path[0])
        items = event_stream(spark, path[0]).withColumn("us", micros("ts"))
        window = Count(3) if kind == "count" else Duration(day / 1e6)
        live.drain(live.windows(items, "user_id", "event_id", "value", window, policy, "us"), path[1], path[2])
    got = spark.read.parquet(path[1]).unionByName(live.tail(spark, path[2], "user_id"))
    s = streams.Stream(src.withColumn("us", micros("ts")), "user_id", "event_id", F.col("event_type") != "error")
    if policy != "skip":  # a key ends at its failure, and its open window is lost
        ends = streams.error_budget(s, 0 if policy == "fail_fast" else 1).select("user_id", "failed_at")
        s = streams.Stream(s.df.join(ends, "user_id").where(F.col("failed_at").isNull() | (F.col("event_id") < F.col("failed_at"))), "user_id", "event_id", s.ok)
        first = src.groupBy("user_id").agg(F.min(micros("ts")).alias("first"))
        s = streams.Stream(s.df.join(first, "user_id"), "user_id", "event_id", s.ok)
    flushed = streams.count_windows(s, 3) if kind == "count" else streams.duration_windows(s, F.col("us"), day)
    want = streams.flush(flushed, s, "value")
    if policy != "skip":
        last = want.groupBy("user_id").agg(F.max("window").alias("last"))
        want = want.join(last, "user_id").join(ends, "user_id").where(F.col("failed_at").isNull() | (F.col("n") == 3 if kind == "count" else F.col("window") < F.col("last"))).select(*want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_greatest_value_ignores_nulls_and_puts_nan_first():
    import math

    from weirflow.streaming.live import greater

    assert greater(None, 1.0) == 1.0 and greater(2.0, None) == 2.0 and greater(None, None) is None
    assert math.isnan(greater(float("nan"), 1.0)) and math.isnan(greater(1.0, float("nan")))


def test_inserting_twice_adds_nothing(spark, tmp_path):
    from weirflow.sources.tables import insert_new

    path, schema = str(tmp_path / "t"), "w string, a string, amount long"
    rows = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("x", None, 3), (None, None, 4)], schema)
    assert insert_new(None, rows, ["w", "a"], path) == 3
    more = rows.unionByName(spark.createDataFrame([("y", None, 5)], schema))
    assert insert_new(spark.read.parquet(path), more, ["w", "a"], path) == 1
    assert insert_new(spark.read.parquet(path), more, ["w", "a"], path) == 0
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == 4


def test_pages_behind_a_cursor(spark):
    from weirflow.sources.tables import after

    df = spark.range(10)
    assert [r["id"] for r in after(df, "id", None, 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in after(df, "id", 7).collect()] == [8, 9]
