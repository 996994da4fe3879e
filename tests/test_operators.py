import pytest
from pyspark.sql import functions as F

from weirflow.operators import folds, splits, streams


def stream(spark, rows):
    df = spark.createDataFrame([(1, i, v, ok) for i, (v, ok) in enumerate(rows)], "k int, seq int, v int, ok boolean")
    return streams.Stream(df, "k", "seq", F.col("ok"))


def test_count_window_keeps_its_tail(spark):
    s = stream(spark, [(v, True) for v in (10, 20, 30, 40, 50)])
    got = streams.count_windows(s, 2).groupBy("window").agg(F.array_sort(F.collect_list(F.col("v") * 2)).alias("x")).orderBy("window").collect()
    assert [r["x"] for r in got] == [[20, 40], [60, 80], [100]]


def test_failed_items_are_skipped(spark):
    s = stream(spark, [(1, True), (2, False), (3, True)])
    assert [r["v"] for r in s.good().orderBy("seq").collect()] == [1, 3]


def test_resume_replays_what_was_not_committed(spark):
    s = stream(spark, [(v, True) for v in range(1, 11)])
    later = s.since(spark.createDataFrame([(1, 5)], "k int, cursor int"))
    got = streams.count_windows(later, 3).groupBy("window").agg(F.array_sort(F.collect_list("v")).alias("x")).orderBy("window").collect()
    assert [r["x"] for r in got] == [[7, 8, 9], [10]]


@pytest.mark.parametrize(("strategy", "parameter", "wins", "want"), [("percentage", 0.75, 3, True), ("percentage", 0.75, 2, False), ("all", 0, 4, True), ("any", 0, 0, False), ("quorum", 2, 2, True)])
def test_join_thresholds(strategy, parameter, wins, want):
    assert splits.satisfied(strategy, wins, 4, 4, parameter) is want


def test_bad_strategies_are_rejected():
    for bad in (("percentage", 0), ("percentage", 1.5), ("nothing", 1)):
        with pytest.raises(ValueError):
            splits.validate(*bad)
    with pytest.raises(ValueError):
        splits.validate("partial_timeout", None)


def test_breaker_opens_and_recovers():
    step, state, seen = folds.breaker_step(2, 10), (folds.CLOSED, 0, 0), []
    for at, failed in ((0, True), (1, True), (5, False), (11, False), (12, True)):
        state, out = step(state, at, failed)
        seen.append(out)
    assert seen == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_limiters():
    step, state, seen = folds.bucket_step(2, 10), None, []
    for at, cost in ((0, 2), (5, 1), (10, 1), (10, 0)):
        state, (ok, _) = step(state, at, cost)
        seen.append(ok)
    assert seen == [True, False, True, True]
    step, state, seen = folds.window_step(2, 10), None, []
    for at, cost in ((0, 2), (9, 1), (10, 1), (19, 1), (20, 2)):
        state, (ok, _) = step(state, at, cost)
        seen.append(ok)
    assert seen == [True, False, True, True, True]


def test_fold_keeps_keys_apart(spark):
    df = spark.createDataFrame([(k, i, float(v)) for k in range(5) for i, v in enumerate((70, 85, 71, 70, 90))], "k int, seq int, v double")
    got = folds.fold(df, "k", "seq", lambda: False, folds.hysteresis_step(80.0, 70.0), ["v"], "mode string").where("k = 3").orderBy("seq").collect()
    assert [r["mode"] for r in got] == ["calm", "alert", "alert", "calm", "alert"]


def test_fold_keeps_null_keys_together_and_large_numbers_whole(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(None, 1, big), (None, 2, None), (None, 3, big + 2), (big, 4, 5), (big + 1, 5, 6)], "k long, seq long, v long")
    step = lambda n, v: (n + 1, (n + 1, v))
    got = {r["seq"]: (r["k"], r["n"], r["same"]) for r in folds.fold(df, "k", "seq", lambda: 0, step, ["v"], "n long, same long").collect()}
    assert got == {1: (None, 1, big), 2: (None, 2, None), 3: (None, 3, big + 2), 4: (big, 1, 5), 5: (big + 1, 1, 6)}


def test_fold_may_read_its_key_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, 5.0)], "k long, seq long, __v0 double")
    got = folds.fold(df, "k", "seq", lambda: 0, lambda s, k, q, v: (s, (k, q, v)), ["k", "seq", "__v0"], "a long, b long, c double").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, 5.0)]


def test_native_hysteresis_equals_the_fold(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(i % 7, i, float(rng.randrange(100))) for i in range(500)], "k int, seq int, v double")
    want = {r["seq"]: r["mode"] for r in folds.fold(df, "k", "seq", lambda: False, folds.hysteresis_step(80.0, 30.0), ["v"], "mode string").collect()}
    assert {r["seq"]: r["mode"] for r in streams.hysteresis(streams.Stream(df, "k", "seq", F.lit(True)), "v", 80.0, 30.0).collect()} == want


def test_mode_windows_of_the_sensor_example(spark):
    readings = [70, 71, 73, 85, 88, 76, 71, 90, 68, 73, 74, 95, 88, 60]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(readings)], "k int, seq int, v double")
    out = folds.fold(df, "k", "seq", lambda: (False, 0, 0, None), folds.mode_windows_step(80, 70, 3, 1), ["v"], "window long, mode string, v double").orderBy("seq").collect()
    assert [r["window"] for r in out] == [0, 0, 0, 1, 1, 1, 2, 3, 4, 5, 5, 5, 6, 7]
    assert [r["mode"] for r in out] == ["calm"] * 6 + ["alert"] * 3 + ["calm"] * 3 + ["alert"] * 2


def test_breaker_closes_after_all_trials():
    step, state, seen = folds.breaker_step(1, 10, 2), (folds.CLOSED, 0, 0), []
    for at, failed in ((0, True), (10, False), (11, False), (12, True), (22, False), (23, True), (24, False)):
        state, out = step(state, at, failed)
        seen.append(out[1])
    assert seen == ["open", "half_open", "closed", "open", "half_open", "open", "open"]


def test_cron_column_equals_the_driver(spark):
    import random
    from datetime import UTC, datetime, timedelta

    from weirflow.flow.schedule import next_cron
    from weirflow.operators import schedules

    rng, epoch = random.Random(2), datetime(1970, 1, 1, tzinfo=UTC)
    at = [datetime(2023, 12, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(90 * 86400), microseconds=rng.choice([0, 1, 999999])) for _ in range(60)]
    at += [datetime(2024, 2, 28, 23, 59, 59, tzinfo=UTC), datetime(2023, 12, 31, 23, 59, 59, 999999, tzinfo=UTC)]
    df = spark.createDataFrame([(i, (t - epoch) // timedelta(microseconds=1)) for i, t in enumerate(at)], "i int, us long")
    for expression in ("0 */15 * * * *", "* * * * * *", "30 10 9-17/4 1,15 * 1-5", "59 59 23 29 2 *", "0 0 0 * * 0", "5,10 0 12 1 */3 *"):
        got = {r["i"]: r["n"] for r in df.select("i", schedules.next_cron(expression, F.col("us")).alias("n")).collect()}
        assert got == {i: (next_cron(expression, t) - epoch) // timedelta(microseconds=1) for i, t in enumerate(at)}


def test_retry_and_backoff_columns_equal_the_driver(spark):
    from weirflow.flow.resilience import Retry
    from weirflow.flow.schedule import Backoff
    from weirflow.operators import schedules

    for retry in (Retry(), Retry(5, 10, 3.0, 200), Retry.fixed(3, 40), Retry(3, 0), Retry(3, 100, -1.0)):
        rows = spark.range(8).select("id", schedules.retry_delay(retry, F.col("id")).alias("d")).collect()
        assert all(r["d"] == pytest.approx(retry.delay(r["id"], 0.0)) for r in rows)
    policy = Backoff(1, 2, 8, 0.0, 3)
    rows = spark.range(6).select("id", schedules.backoff_delay(policy, F.col("id")).alias("d"), schedules.tripped(policy, F.col("id")).alias("t")).collect()
    assert all(r["d"] == (policy.delay(r["id"], 0.0) if r["id"] else 0) and r["t"] == policy.tripped(r["id"]) for r in rows)


def test_item_attempts_equal_the_live_batch(spark):
    from weirflow.flow.resilience import Retry
    from weirflow.flow.stages import Batch
    from weirflow.operators import batches

    tried = {}

    def work(i):
        tried[i] = tried.get(i, 0) + 1
        if tried[i] <= i:
            raise ValueError
        return i

    slots = Batch(None, work, None, 1, Retry.fixed(2, 0))._slots(range(5), None)
    n, ok = batches.attempts(F.col("id"), 3)
    got = spark.range(5).select("id", n.alias("n"), ok.alias("ok")).orderBy("id").collect()
    assert [(r["n"], r["ok"]) for r in got] == [(tried[i], slots[i].ok) for i in range(5)]


def test_prepositions_of_empty_and_odd_texts(spark):
    from weirflow.operators import text

    df = spark.createDataFrame([(1, None), (2, ""), (3, " 12 -- "), (4, "In (the) in-to into! 'OVER' 1about2 x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["total_words"], r["unique_prepositions"], r["density"]) for r in text.prepositions(df).collect()}
    assert got == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (7, 4, round(400 / 7, 6))}


def test_tiers_in_order_with_filter_and_wait():
    step, state, seen = folds.multi_step(folds.bucket_step(3, 2000), folds.window_step(4, 10_000), folds.window_step(100, 10**6)), None, []
    for at, cost, only in ((0, 2, None), (0, 2, None), (2000, 2, None), (2000, 1, [2]), (3000, 0, None), (10_000, 3, [2, 3])):
        state, out = step(state, at, cost, only)
        seen.append(out)
    assert seen == [(True, 0, 0), (False, 1, 2000), (True, 0, 0), (False, 2, 8000), (True, 0, 0), (True, 0, 0)]


def test_writes_replayed_equal_the_live_store(spark):
    import random

    from weirflow.flow.store import Store
    from weirflow.operators import stores

    rng, live, lists = random.Random(4), Store(), Store()
    rows = [(n, rng.choice("abcde"), str(rng.randrange(9)), rng.random() < 0.2) for n in range(200)]
    for _, k, v, removed in rows:
        live.pop(k, None) if removed else live.__setitem__(k, v)
        lists.append(k, v)
    log = spark.createDataFrame(rows, "seq int, key string, value string, removed boolean")
    assert {r["key"]: r["value"] for r in stores.last_write(log, "key", "seq", F.col("value"), F.col("removed")).collect()} == dict(live)
    assert {r["key"]: r["appended"].split(",") for r in stores.appended(log, "key", "seq", "value").collect()} == dict(lists)


def test_health_and_dangling_edges_equal_the_live_ones(spark):
    from weirflow.flow import graph, store
    from weirflow.flow.errors import ConfigurationError
    from weirflow.flow.testing import CountedResource
    from weirflow.operators import stores

    levels = [0, 1, 2, 2, 1]
    held = store.Resources({k: CountedResource(str(k), [], health=store.HEALTH[v]) for k, v in enumerate(levels)})
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(levels)], "g int, k int, v int")
    r = stores.health(df, "g", "k", F.col("v")).first()
    assert (r["resource"], r["health"]) == held.worst()
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "nowhere")], "from_state string, missing string")
    assert [tuple(x) for x in stores.dangling(edges, ["a", "b"]).collect()] == [("b", "nowhere")]
    with pytest.raises(ConfigurationError):
        graph.Workflow().split("b", [], "nowhere").exit("end").validate()
