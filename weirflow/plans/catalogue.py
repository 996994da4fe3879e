"""Every registered query, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions.clock import micros
from weirflow.flow.resilience import Retry
from weirflow.flow.schedule import Backoff
from weirflow.operators import batches, folds, recovery, schedules, splits, stores, streams, text
from weirflow.plans.registry import query
from weirflow.plans.runtime import table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def events(spark: SparkSession, sf_dir: str) -> streams.Stream:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))
    return streams.Stream(df, "user_id", "event_id", F.col("event_type") != "error")


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, event_type <> 'error' AS ok FROM events)"
_W = f"{_E}, w AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS win FROM e WHERE ok)"
_F = f"{_W}, f AS (SELECT user_id, win::BIGINT AS \"window\", count(*)::BIGINT AS n, max(value) AS max_value, max(event_id) AS cursor FROM w GROUP BY ALL)"


# --- streams -------------------------------------------------------------------------------


@query(f"WITH {_F} SELECT * FROM f")
def stream_count_window(spark, sf_dir):
    s = events(spark, sf_dir)
    return streams.flush(streams.count_windows(s, 3), s, "value")


@query(f"""WITH {_E}, t AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM e)
SELECT user_id, ((us - t0) // {DAY})::BIGINT AS "window", count(*)::BIGINT AS n, max(value) AS max_value, max(event_id) AS cursor FROM t WHERE ok GROUP BY ALL""")
def stream_duration_window(spark, sf_dir):
    s = events(spark, sf_dir)
    return streams.flush(streams.duration_windows(s, F.col("us"), DAY), s, "value")


@query(f"WITH {_F}, d AS (SELECT user_id, count(*) FILTER (NOT ok)::BIGINT AS dropped FROM e GROUP BY 1) SELECT user_id, coalesce(count(f.n), 0)::BIGINT AS windows, coalesce(sum(f.n), 0)::BIGINT AS kept, any_value(dropped) AS dropped FROM d LEFT JOIN f USING (user_id) GROUP BY 1")
def stream_skip_and_continue(spark, sf_dir):
    return streams.skip_and_continue(events(spark, sf_dir), 3)


@query(f"""WITH {_E}, x AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM e),
k AS (SELECT user_id, count(*) FILTER (bad = 0) AS good, max(bad) > 0 AS failed FROM x GROUP BY 1),
k2 AS (SELECT *, (CASE WHEN failed THEN good // 3 ELSE (good + 2) // 3 END)::BIGINT AS windows FROM k),
r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS win FROM x WHERE bad = 0)
SELECT k2.user_id, windows, max(event_id) AS cursor, failed FROM k2 LEFT JOIN r ON r.user_id = k2.user_id AND r.win < windows GROUP BY ALL""")
def stream_fail_fast(spark, sf_dir):
    return streams.fail_fast(events(spark, sf_dir), 3)


@query(f"""WITH {_E}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM e),
k AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, good ORDER BY event_id) AS streak FROM g)
SELECT user_id, min(event_id) FILTER (streak > 1) AS failed_at, coalesce(min(good) FILTER (streak > 1), max(good))::BIGINT AS processed FROM k GROUP BY 1""")
def stream_error_budget(spark, sf_dir):
    return streams.error_budget(events(spark, sf_dir), 1)


@query(f"""WITH {_F}, b AS (SELECT *, coalesce(max((max_value > 150)::INT) OVER (PARTITION BY user_id ORDER BY "window" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS asked FROM f)
SELECT user_id, "window", n, max_value, cursor, max_value > 150 AS stopped FROM b WHERE asked = 0""")
def stream_stop_signal(spark, sf_dir):
    s = events(spark, sf_dir)
    return streams.until_stop(streams.flush(streams.count_windows(s, 3), s, "value"), s, F.col("max_value") > 150)


@query(f'WITH {_F} SELECT user_id, max("window") AS last_window, arg_max(n, "window") AS items, arg_max(n, "window") < 3 AS partial FROM f GROUP BY 1')
def stream_exhausted_tail(spark, sf_dir):
    s = events(spark, sf_dir)
    last = streams.flush(streams.count_windows(s, 3), s, "value").groupBy("user_id").agg(F.max("window").alias("last_window"), F.max_by("n", "window").alias("items"))
    return last.withColumn("partial", F.col("items") < 3)


@query(f'WITH {_F} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY "window")::BIGINT AS sequence, "window", cursor FROM f')
def stream_cursor_log(spark, sf_dir):
    s = events(spark, sf_dir)
    return streams.cursor_log(streams.flush(streams.count_windows(s, 3), s, "value"), s)


@query(f"""WITH {_F}, c AS (SELECT user_id, cursor FROM f WHERE "window" = 1),
r AS (SELECT e.*, (row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) - 1) // 3 AS win FROM e LEFT JOIN c USING (user_id) WHERE ok AND (cursor IS NULL OR event_id > cursor))
SELECT user_id, win::BIGINT AS "window", count(*)::BIGINT AS n, max(value) AS max_value, max(event_id) AS cursor FROM r GROUP BY ALL""")
def stream_resume(spark, sf_dir):
    s = events(spark, sf_dir)
    committed = streams.flush(streams.count_windows(s, 3), s, "value").where("window = 1")
    later = s.since(committed)
    return streams.flush(streams.count_windows(later, 3), later, "value")


_R = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e)"


@query(f"""WITH RECURSIVE {_E}, {_R}, h AS (
SELECT user_id, event_id, rn, value >= 120 AS alert FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN h.alert THEN o.value > 20 ELSE o.value >= 120 END FROM h JOIN o ON o.user_id = h.user_id AND o.rn = h.rn + 1)
SELECT user_id, event_id, CASE WHEN alert THEN 'alert' ELSE 'calm' END AS mode FROM h""")
def stream_hysteresis(spark, sf_dir):
    return streams.hysteresis(events(spark, sf_dir), "value", 120.0, 20.0)


@query(f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e WHERE ok), c AS (
SELECT user_id, event_id, rn, value, 0::BIGINT AS win, 1 AS held, value AS top, false AS alert FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, value, CASE WHEN ended THEN win + 1 ELSE win END, CASE WHEN ended THEN 1 ELSE held + 1 END, CASE WHEN ended THEN value ELSE greatest(top, value) END,
CASE WHEN NOT ended THEN alert WHEN alert THEN top > 20 ELSE top >= 120 END
FROM (SELECT o.user_id, o.event_id, o.rn, o.value, c.win, c.held, c.top, c.alert, c.held >= CASE WHEN c.alert THEN 1 ELSE 3 END AS ended FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, win AS "window", CASE WHEN any_value(alert) THEN 'alert' ELSE 'calm' END AS mode, count(*)::BIGINT AS n, max(value) AS max_value, max(event_id) AS cursor FROM c GROUP BY 1, 2""")
def stream_mode_windows(spark, sf_dir):
    """Windows of three items while calm and of one while alert; a window's greatest value switches the mode."""
    s = events(spark, sf_dir)
    made = folds.fold(s.good(), "user_id", "event_id", lambda: (False, 0, 0, None), folds.mode_windows_step(120.0, 20.0, 3, 1), ["value"], "window long, mode string, value double")
    return made.groupBy("user_id", "window").agg(F.max("mode").alias("mode"), F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"), F.max("event_id").alias("cursor"))


@query(f"""WITH {_W}, b AS (SELECT w.*, strlen(props) AS bytes FROM w JOIN events USING (event_id))
SELECT user_id, win::BIGINT AS "window", round(avg(value), 6) AS mean_value, max(value) AS max_value, sum(bytes)::BIGINT AS n_bytes FROM b GROUP BY ALL""".replace("w.*", "w.user_id, w.win, w.value"))
def stream_window_sizes(spark, sf_dir):
    """Mean, greatest value and bytes of each window."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.octet_length("props").cast("long").alias("bytes"), (F.col("event_type") != "error").alias("ok"))
    kept = streams.count_windows(streams.Stream(df, "user_id", "event_id", F.col("ok")), 3)
    return kept.groupBy("user_id", "window").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), F.sum("bytes").alias("n_bytes"))


# --- batches ----------------------------------------------------------------------------------

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_B = f"b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS rn, l_returnflag <> 'R' AS ok, epoch_us(l_shipdate) AS us FROM lineitem)"


def items(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return df.withColumn("idx", F.row_number().over(w).cast("long") - 1).withColumn("ok", F.col("l_returnflag") != "R")


@query(f"WITH {_B} SELECT l_orderkey, (rn - 1)::BIGINT AS idx, CASE WHEN ok THEN l_quantity * 10 END AS value, CASE WHEN NOT ok THEN 'task_execution' END AS error FROM b")
def batch_ordered_slots(spark, sf_dir):
    return batches.slots(items(spark, sf_dir), ["l_orderkey", "idx"], batches.failing(F.col("ok")), F.col("l_quantity") * 10)


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS n_ok, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_error, round(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0), 4) AS ok_sum FROM lineitem GROUP BY 1")
def batch_partial_failure(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return batches.finish(batches.slots(df, ["l_orderkey"], batches.failing(F.col("l_returnflag") != "R"), F.col("l_quantity")), "l_orderkey")


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE 3 END::BIGINT AS attempts, event_id % 5 < 3 AS succeeded FROM events""")
def batch_item_retry(spark, sf_dir):
    """Item i fails its first i mod 5 attempts; three attempts are allowed."""
    tried, succeeded = batches.attempts(F.col("event_id") % 5, 3)
    return table(spark, sf_dir, "events").select("event_id", tried.alias("attempts"), succeeded.alias("succeeded"))


@query("SELECT event_id, CASE WHEN value <= 100 THEN value END AS value, CASE WHEN value > 100 THEN 'timeout' END AS error FROM events")
def attempt_timeout(spark, sf_dir):
    """Items whose work takes longer (values are seconds) than an attempt may are errors of their own kind."""
    return batches.slots(table(spark, sf_dir, "events"), ["event_id"], batches.late(F.col("value"), 100), F.col("value"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN strlen(url)::BIGINT END AS value, CASE WHEN NOT starts_with(url, 'https://') THEN 'task_execution' END AS error FROM pages")
def scheme_slots(spark, sf_dir):
    """Addresses of one scheme are worked on, others are errors in their slots."""
    url = F.coalesce("url", F.lit(""))
    return batches.slots(table(spark, sf_dir, "pages"), ["page_id"], batches.failing(F.startswith(url, F.lit("https://"))), F.octet_length(url).cast("long"))


@query("SELECT d.doc_id, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'key_not_found' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def lookup_or_error(spark, sf_dir):
    """A label for each document, or the error of a missing key."""
    return batches.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "toxic")


# --- splits -----------------------------------------------------------------------------------

_S = f"""{_B}, s AS (SELECT l_orderkey AS grp, rn - 1 AS place, us AS finished_at, ok FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY us, rn) AS rn) FROM b)),
d AS (SELECT grp, place, finished_at, ok, min(finished_at) OVER (PARTITION BY grp) + {30 * DAY} AS deadline, coalesce(sum(ok::INT) OVER (PARTITION BY grp ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM s)"""


def branches(spark, sf_dir) -> DataFrame:
    timed = items(spark, sf_dir).select(F.col("l_orderkey").alias("grp"), "idx", micros("l_shipdate").alias("finished_at"), "ok")
    group = Window.partitionBy("grp")
    return timed.withColumn("place", F.row_number().over(group.orderBy("finished_at", "idx")) - 1).withColumn("deadline", F.min("finished_at").over(group) + 30 * DAY)


def _split_sql(seen: str, reached: str, need: str) -> str:
    return f"""WITH {_S}, m AS (SELECT *, {seen} AS seen FROM d)
SELECT grp, count(*) FILTER (seen AND ok)::BIGINT AS successes, count(*) FILTER (seen AND NOT ok)::BIGINT AS errors, count(*) FILTER (NOT seen)::BIGINT AS cancelled,
count(*) FILTER ({reached}) >= {need} AS satisfied FROM m GROUP BY 1"""


for _strategy, _parameter, _sql in (
    ("all", 0, _split_sql("true", "ok", "count(*)")),
    ("any", 0, _split_sql("wins < 1", "seen AND ok", "1")),
    ("quorum", 2, _split_sql("true", "ok", "2")),
    ("percentage", 0.75, _split_sql("true", "ok", "ceil(count(*) * 0.75)")),
    ("partial_results", 2, _split_sql("wins < 2", "seen AND ok", "2")),
    ("partial_timeout", 0, _split_sql("finished_at <= deadline", "seen", "1")),
):
    query(_sql, f"split_join_{_strategy}")(lambda spark, sf_dir, s=_strategy, p=_parameter: splits.complete(branches(spark, sf_dir), s, p))


@query(f"WITH {_S} SELECT grp, count(*) FILTER (finished_at > deadline)::BIGINT AS late, CASE WHEN count(*) FILTER (finished_at > deadline) > 0 THEN 'Split task timeout exceeded' END AS error FROM d GROUP BY 1")
def split_timeout_error(spark, sf_dir):
    late = F.count_if(F.col("finished_at") > F.col("deadline"))
    return branches(spark, sf_dir).groupBy("grp").agg(late.alias("late"), F.when(late > 0, "Split task timeout exceeded").alias("error"))


@query("WITH b AS (SELECT k, sum(l_linenumber * k)::BIGINT AS total FROM lineitem, (VALUES (1), (2), (3)) v(k) GROUP BY k) SELECT k::INTEGER AS branch, total FROM b UNION ALL SELECT 0, sum(total)::BIGINT FROM b")
def split_branch_sum(spark, sf_dir):
    """Three branches scale the same items by 1, 2 and 3; branch 0 is the joined total."""
    one = table(spark, sf_dir, "lineitem").agg(F.sum("l_linenumber").alias("s"))
    each = one.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("branch"), "s").select("branch", (F.col("s") * F.col("branch")).alias("total"))
    return each.unionByName(each.agg(F.lit(0).alias("branch"), F.sum("total").alias("total")))


# --- routing, polling, timers, steps --------------------------------------------------------------


@query("SELECT CASE WHEN event_type = 'error' THEN 'recover' WHEN value >= 100 THEN 'large' ELSE 'small' END AS route, count(*)::BIGINT AS n FROM events GROUP BY 1")
def router_route(spark, sf_dir):
    route = F.when(F.col("event_type") == "error", "recover").when(F.col("value") >= 100, "large").otherwise("small")
    return table(spark, sf_dir, "events").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_E}, {_R}, p AS (SELECT user_id, min(rn) FILTER (event_type = 'purchase')::BIGINT AS found, min(event_id) FILTER (event_type = 'purchase') AS ended_at, max(rn)::BIGINT AS n FROM o GROUP BY 1)
SELECT user_id, coalesce(found, n) AS polls, CASE WHEN found IS NULL THEN 'pending' ELSE 'ready' END AS outcome, ended_at FROM p""")
def poll_until_ready(spark, sf_dir):
    """The first purchase of a user is the answer a poll waits for, whatever errors come before."""
    return streams.poll(events(spark, sf_dir), F.col("event_type") == "purchase", 2**31 - 1)


@query(f"""WITH {_E}, {_R}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM o),
k AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, good ORDER BY event_id) AS streak FROM g),
f AS (SELECT user_id, min(rn) FILTER (event_type = 'purchase' OR streak > 1)::BIGINT AS found, max(rn)::BIGINT AS n FROM k GROUP BY 1)
SELECT f.user_id, coalesce(found, n) AS polls, CASE WHEN found IS NULL THEN 'pending' WHEN k.event_type = 'purchase' THEN 'ready' ELSE 'failed' END AS outcome, k.event_id AS ended_at
FROM f LEFT JOIN k ON k.user_id = f.user_id AND k.rn = f.found""")
def poll_error_budget(spark, sf_dir):
    """One error in a row is allowed; any other answer clears the count."""
    return streams.poll(events(spark, sf_dir), F.col("event_type") == "purchase", 1)


@query(f"WITH {_E} SELECT event_id, greatest(us, 1704067200000000 + (value * 1000)::BIGINT * 1000000)::BIGINT AS due_us FROM e")
def timer_due(spark, sf_dir):
    """A timer until an instant fires at once when that has passed."""
    until = F.lit(1704067200000000) + F.round(F.col("value") * 1000).cast("long") * 1000000
    return events(spark, sf_dir).df.select("event_id", F.greatest("us", until).alias("due_us"))


@query(f"WITH {_E}, {_R} SELECT user_id, ((rn - 1) // 10)::BIGINT AS page, count(*)::BIGINT AS n, max(event_id) AS cursor FROM o GROUP BY ALL")
def stepped_pages(spark, sf_dir):
    s = events(spark, sf_dir)
    pages = s.df.withColumn("page", F.floor((F.row_number().over(s.by_key()) - 1) / 10).cast("long"))
    return pages.groupBy("user_id", "page").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("cursor"))


# --- retry, back-off, schedules ---------------------------------------------------------------------


@query("SELECT s_suppkey, k::INTEGER AS attempt, least((100 + s_nationkey) * pow(2, k), 30000)::DOUBLE AS delay_ms FROM supplier, range(6) r(k)")
def retry_schedule(spark, sf_dir):
    """Pauses before six retries, from a base that differs from supplier to supplier."""
    tries = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 100).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))
    return tries.select("s_suppkey", "attempt", schedules.retry_delay(Retry(), F.col("attempt"), F.col("base")).alias("delay_ms"))


@query(f"""WITH {_E}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM e),
k AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, good ORDER BY event_id)::BIGINT AS streak FROM g)
SELECT event_id, streak, CASE WHEN ok THEN 0.0 ELSE least(pow(2, streak - 1), 8) END::DOUBLE AS delay_s, streak >= 3 AS tripped FROM k""")
def scheduler_backoff(spark, sf_dir):
    s = events(spark, sf_dir)
    policy = Backoff(1, 2, 8, 0.0, 3)
    island = s.df.withColumn("good", F.sum(s.ok.cast("int")).over(s.by_key(upto=True)))
    streak = F.sum((~s.ok).cast("int")).over(Window.partitionBy("user_id", "good").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = island.withColumn("streak", streak)
    return counted.select("event_id", "streak", schedules.backoff_delay(policy, F.col("streak")).alias("delay_s"), schedules.tripped(policy, F.col("streak")).alias("tripped"))


@query(f"""WITH {_E} SELECT event_id, (coalesce(sum((value * 1000)::BIGINT + 60000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms FROM e""")
def scheduler_fixed_delay(spark, sf_dir):
    """Runs start a minute after the one before has ended; values are seconds of work."""
    took = F.round(F.col("value") * 1000).cast("long")
    return events(spark, sf_dir).df.select("event_id", schedules.fixed_delay_start("user_id", "event_id", took, 60000).alias("start_ms"))


@query(f"WITH {_E} SELECT event_id, ((us // {HOUR // 4} + 1) * {HOUR // 4})::BIGINT AS next_us FROM e")
def scheduler_cron(spark, sf_dir):
    """The next instant after each event at which ``0 */15 * * * *`` fires."""
    return events(spark, sf_dir).df.select("event_id", schedules.next_cron("0 */15 * * * *", F.col("us")).alias("next_us"))


@query(f"""WITH {_E}, d AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts) + INTERVAL 40 DAY, INTERVAL 1 DAY)) AS day FROM events),
c AS (SELECT epoch_us(day) + (h * 3600 + 10 * 60 + 30)::BIGINT * 1000000 AS fires FROM d, (VALUES (9), (13), (17)) v(h) WHERE (dayofmonth(day) = 1 OR dayofmonth(day) = 15 OR dayofmonth(day) >= 28) AND dayofweek(day) BETWEEN 1 AND 5)
SELECT event_id, c.fires::BIGINT AS next_us FROM e ASOF JOIN c ON e.us < c.fires""")
def scheduler_cron_calendar(spark, sf_dir):
    """The next instant after each event of a schedule with hours, days of the month and weekdays."""
    return events(spark, sf_dir).df.select("event_id", schedules.next_cron("30 10 9-17/4 1,15,28-31 * 1-5", F.col("us")).alias("next_us"))


# --- folds ------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, true AS admitted, CASE WHEN NOT ok AND 2 <= 1 THEN 'open' ELSE 'closed' END AS state, (NOT ok)::INT AS fails, 0::BIGINT AS opened FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, admitted, CASE WHEN NOT admitted THEN 'open' WHEN ok THEN 'closed' WHEN half OR fails + 1 >= 2 THEN 'open' ELSE 'closed' END,
CASE WHEN NOT admitted THEN fails WHEN ok OR half OR fails + 1 >= 2 THEN 0 ELSE fails + 1 END, CASE WHEN admitted AND NOT ok AND (half OR fails + 1 >= 2) THEN us ELSE opened END
FROM (SELECT o.user_id, o.event_id, o.rn, o.ok, o.us, c.fails, c.opened, c.state = 'open' AS half, NOT (c.state = 'open' AND o.us - c.opened < {DAY}) AS admitted FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, event_id, admitted, state FROM c""")
def circuit_breaker(spark, sf_dir):
    s = events(spark, sf_dir)
    rows = s.df.withColumn("failed", ~s.ok)
    return folds.fold(rows, "user_id", "event_id", lambda: (folds.CLOSED, 0, 0), folds.breaker_step(2, DAY), ["us", "failed"], "admitted boolean, state string")


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, true AS admitted, CASE WHEN ok THEN 'closed' ELSE 'open' END AS state, 0 AS won, CASE WHEN ok THEN 0 ELSE us END::BIGINT AS opened FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, admitted, CASE WHEN NOT admitted OR NOT ok THEN 'open' WHEN half AND won + 1 < 2 THEN 'half_open' ELSE 'closed' END,
CASE WHEN admitted AND ok AND half AND won + 1 < 2 THEN won + 1 ELSE 0 END, CASE WHEN admitted AND NOT ok THEN us ELSE opened END
FROM (SELECT o.user_id, o.event_id, o.rn, o.ok, o.us, c.opened, CASE WHEN c.state = 'half_open' THEN c.won ELSE 0 END AS won, c.state <> 'closed' AS half, NOT (c.state = 'open' AND o.us - c.opened < {DAY}) AS admitted
  FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, event_id, admitted, state FROM c""")
def half_open_trials(spark, sf_dir):
    """A breaker that opens at one failure and closes when two trials in a row succeed."""
    rows = events(spark, sf_dir).df.withColumn("failed", F.col("event_type") == "error")
    return folds.fold(rows, "user_id", "event_id", lambda: (folds.CLOSED, 0, 0), folds.breaker_step(1, DAY, 2), ["us", "failed"], "admitted boolean, state string")


_COST = "(event_id % 3)::BIGINT"


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, us, true AS admitted, (3 * {DAY} - {_COST} * {DAY})::BIGINT AS credit FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, us, cost = 0 OR cost * {DAY} <= has, CASE WHEN cost * {DAY} <= has THEN has - cost * {DAY} ELSE has END
FROM (SELECT o.user_id, o.event_id, o.rn, o.us, o.event_id % 3 AS cost, least(3 * {DAY}, c.credit + o.us - c.us)::BIGINT AS has FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, event_id, admitted, credit FROM c""")
def token_bucket(spark, sf_dir):
    rows = events(spark, sf_dir).df.withColumn("cost", F.col("event_id") % 3)
    return folds.fold(rows, "user_id", "event_id", lambda: None, folds.bucket_step(3, DAY), ["us", "cost"], "admitted boolean, credit long")


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, us AS start, true AS admitted, {_COST} AS used FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, start, cost = 0 OR used + cost <= 2, CASE WHEN used + cost <= 2 THEN used + cost ELSE used END
FROM (SELECT o.user_id, o.event_id, o.rn, o.event_id % 3 AS cost, CASE WHEN o.us - c.start >= {DAY} THEN o.us ELSE c.start END AS start, CASE WHEN o.us - c.start >= {DAY} THEN 0 ELSE c.used END AS used FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, event_id, admitted, used FROM c""")
def window_limiter(spark, sf_dir):
    rows = events(spark, sf_dir).df.withColumn("cost", F.col("event_id") % 3)
    return folds.fold(rows, "user_id", "event_id", lambda: None, folds.window_step(2, DAY), ["us", "cost"], "admitted boolean, used long")


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, us, us AS start, (3 * {DAY} - {_COST} * {DAY})::BIGINT AS credit, {_COST} AS used, true AS admitted, 0 AS tier, 0::BIGINT AS retry_after FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, us, start, CASE WHEN a AND b THEN credit - cost * {DAY} ELSE credit END, CASE WHEN a AND b THEN used + cost ELSE used END, a AND b, CASE WHEN NOT a THEN 1 WHEN NOT b THEN 2 ELSE 0 END,
CASE WHEN NOT a THEN greatest(cost * {DAY} - credit, 1000) WHEN NOT b THEN greatest(start + {3 * DAY} - us, 1000) ELSE 0 END
FROM (SELECT *, cost = 0 OR cost * {DAY} <= credit AS a, cost = 0 OR used + cost <= 4 AS b
  FROM (SELECT o.user_id, o.event_id, o.rn, o.us, o.event_id % 3 AS cost, least(3 * {DAY}, c.credit + o.us - c.us)::BIGINT AS credit,
    CASE WHEN o.us - c.start >= {3 * DAY} THEN o.us ELSE c.start END AS start, CASE WHEN o.us - c.start >= {3 * DAY} THEN 0 ELSE c.used END AS used FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1)))
SELECT user_id, event_id, admitted, tier, retry_after FROM c""")
def multi_rate_limiter(spark, sf_dir):
    rows = events(spark, sf_dir).df.withColumn("cost", F.col("event_id") % 3)
    step = folds.multi_step(folds.bucket_step(3, DAY), folds.window_step(4, 3 * DAY))
    return folds.fold(rows, "user_id", "event_id", lambda: None, step, ["us", "cost"], "admitted boolean, tier int, retry_after long")


@query(f"""WITH RECURSIVE {_E}, {_R}, c AS (
SELECT user_id, event_id, rn, 1000::BIGINT AS offer, CASE WHEN 1000 <= 100 + user_id THEN 'deal' ELSE '' END AS outcome FROM o WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, offer, CASE WHEN outcome <> '' THEN outcome WHEN offer <= budget THEN 'deal' WHEN rn >= 10 AND offer / budget > 3 THEN 'no_deal' ELSE '' END
FROM (SELECT o.user_id, o.event_id, o.rn, (100 + o.user_id) AS budget, c.outcome, CASE WHEN c.outcome <> '' THEN c.offer ELSE greatest(c.offer - floor(o.value)::BIGINT, 100) END AS offer FROM c JOIN o ON o.user_id = c.user_id AND o.rn = c.rn + 1))
SELECT user_id, min(rn) FILTER (outcome <> '')::BIGINT AS rounds, arg_max(offer, rn)::BIGINT AS offer, coalesce(max(nullif(outcome, '')), 'open') AS outcome FROM c GROUP BY 1""")
def negotiation_rounds(spark, sf_dir):
    s = events(spark, sf_dir)
    rows = s.df.select("user_id", "event_id", F.lit(1000).cast("long").alias("opening"), (F.col("user_id") + 100).alias("budget"), F.floor("value").cast("long").alias("reduction"))
    made = folds.fold(rows, "user_id", "event_id", lambda: (0, 0, ""), folds.negotiation_step(100, 10, 3.0), ["opening", "budget", "reduction"], "turn long, offer long, outcome string")
    ended = F.col("outcome") != ""
    return made.groupBy("user_id").agg(F.min(F.when(ended, F.col("turn"))).alias("rounds"), F.max_by("offer", "event_id").alias("offer"), F.coalesce(F.max(F.when(ended, F.col("outcome"))), F.lit("open")).alias("outcome"))


# --- saga and recovery ---------------------------------------------------------------------------------

_LOG = f"""{_E}, g AS (SELECT user_id AS workflow_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, event_type AS state, 'task_' || event_type AS task_id, (event_id % 3)::INTEGER AS kind, event_id AS blob FROM e)"""


def log(spark, sf_dir) -> DataFrame:
    """A checkpoint log drawn from the events: a run for each user, a row for each event."""
    s = events(spark, sf_dir)
    return s.df.select(
        F.col("user_id").alias("workflow_id"), (F.row_number().over(s.by_key()) - 1).cast("long").alias("sequence"), F.col("event_type").alias("state"),
        F.concat(F.lit("task_"), "event_type").alias("task_id"), (F.col("event_id") % 3).cast("int").alias("kind"), F.col("event_id").alias("blob"), F.lit(0).cast("long").alias("workflow_version"),
    )


@query(f"""WITH {_LOG}, f AS (SELECT workflow_id, min(sequence) AS failed_at FROM g WHERE state = 'error' GROUP BY 1)
SELECT g.workflow_id, sequence::BIGINT AS sequence, task_id, row_number() OVER (PARTITION BY g.workflow_id ORDER BY sequence DESC)::BIGINT AS undo_order FROM g JOIN f USING (workflow_id) WHERE kind = 1 AND sequence < failed_at""")
def saga_rollback(spark, sf_dir):
    return recovery.rollback(log(spark, sf_dir), F.col("state") == "error")


@query(f"""WITH {_LOG}, f AS (SELECT workflow_id, min(sequence) AS failed_at FROM g WHERE state = 'error' GROUP BY 1),
u AS (SELECT f.workflow_id, count(g.sequence)::BIGINT AS undone, count(*) FILTER (g.state = 'purchase')::BIGINT AS failed FROM f LEFT JOIN g ON g.workflow_id = f.workflow_id AND kind = 1 AND sequence < failed_at GROUP BY 1)
SELECT workflow_id, undone, failed, CASE WHEN undone = 0 THEN 'original_error' WHEN failed = 0 THEN 'rolled_back' ELSE 'compensation_failed' END AS outcome FROM u""")
def saga_outcome(spark, sf_dir):
    """Undoing a purchase fails; a clean rollback clears the log, a dirty one keeps it."""
    return recovery.outcome(log(spark, sf_dir), F.col("state") == "error", F.col("state") == "purchase")


@query(f"WITH {_LOG} SELECT workflow_id, arg_max(state, sequence) AS state, (max(sequence) + 1)::BIGINT AS start_sequence FROM g GROUP BY 1")
def recovery_resume_point(spark, sf_dir):
    return recovery.resume_point(log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT workflow_id, state, arg_max(blob, sequence) AS cursor FROM g WHERE kind = 2 GROUP BY 1, 2")
def recovery_cursors(spark, sf_dir):
    return recovery.cursors(log(spark, sf_dir))


@query(f"""WITH {_LOG}, l AS (SELECT workflow_id, max(sequence) AS last FROM g GROUP BY 1)
SELECT g.workflow_id, sequence::BIGINT AS sequence, task_id, blob FROM g JOIN l USING (workflow_id) WHERE kind = 1 AND sequence <> last""")
def recovery_stack(spark, sf_dir):
    return recovery.stack(log(spark, sf_dir))


@query(f"""WITH {_LOG}, l AS (SELECT workflow_id, max(sequence) AS last, arg_max(state, sequence) AS resume FROM g GROUP BY 1),
c AS (SELECT l.workflow_id, coalesce(max(sequence), any_value(last) + 1) AS cutoff FROM l LEFT JOIN g ON g.workflow_id = l.workflow_id AND kind = 0 AND state = resume GROUP BY 1)
SELECT g.workflow_id, sequence::BIGINT AS sequence, state FROM g JOIN c USING (workflow_id) WHERE kind = 0 AND sequence < cutoff""")
def recovery_path(spark, sf_dir):
    return recovery.path(log(spark, sf_dir))


@query(f"""WITH {_LOG}, k AS (SELECT workflow_id, sequence // 2 AS sequence, blob FROM g)
SELECT workflow_id, sequence::BIGINT AS sequence, min(blob) AS kept, (count(*) - 1)::BIGINT AS rejected FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def checkpoint_conflicts(spark, sf_dir):
    clashing = log(spark, sf_dir).withColumn("sequence", F.floor(F.col("sequence") / 2).cast("long"))
    return recovery.conflicts(clashing, "blob")


# --- store, resources, metrics, validation ----------------------------------------------------------------


@query(f"WITH {_E} SELECT user_id, arg_max(event_type, event_id) AS value FROM e GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def store_last_write(spark, sf_dir):
    """Puts by user, the last one wins; an error event removes the key."""
    return stores.last_write(events(spark, sf_dir).df, "user_id", "event_id", F.col("event_type"), F.col("event_type") == "error")


@query(f"WITH {_E} SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS appended FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def store_append(spark, sf_dir):
    kept = events(spark, sf_dir).df.where(F.col("event_type").isin("purchase", "signup"))
    return stores.appended(kept, "user_id", "event_id", "event_type")


@query("""WITH h AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal < 0 THEN 2 WHEN s_acctbal < 2000 THEN 1 ELSE 0 END AS severity FROM supplier)
SELECT s_nationkey, ['healthy', 'degraded', 'unhealthy'][max(severity) + 1] AS health, min(s_suppkey) FILTER (severity = worst) AS resource FROM (SELECT *, max(severity) OVER (PARTITION BY s_nationkey) AS worst FROM h) GROUP BY 1""")
def resource_health(spark, sf_dir):
    """The worst health of a group; of equals the first registered counts."""
    severity = F.when(F.col("s_acctbal") < 0, 2).when(F.col("s_acctbal") < 2000, 1).otherwise(0)
    return stores.health(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", severity)


@query("SELECT event_type AS metric, count(*)::BIGINT AS n, round(sum(value), 2) AS total, max(value) AS greatest FROM events GROUP BY 1")
def metrics_rollup(spark, sf_dir):
    return stores.histogram(table(spark, sf_dir, "events"), "event_type", "value")


_EDGES = f"""{_E}, t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM e)"""


@query(f"WITH {_EDGES} SELECT DISTINCT src AS from_state, dst AS missing FROM t WHERE dst IS NOT NULL AND dst NOT IN ('click', 'view', 'signup')")
def workflow_validate(spark, sf_dir):
    """Edges of the observed graph that lead to no registered state."""
    s = events(spark, sf_dir)
    edges = s.df.select(F.col("event_type").alias("from_state"), F.lead("event_type").over(s.by_key()).alias("missing")).where("missing is not null")
    return stores.dangling(edges, ("click", "view", "signup"))


@query(f"WITH {_E} SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS path, count(*)::BIGINT AS steps FROM e GROUP BY 1")
def transition_path(spark, sf_dir):
    return stores.appended(events(spark, sf_dir).df, "user_id", "event_id", "event_type", ">").select("user_id", F.col("appended").alias("path"), (F.size(F.split("appended", ">"))).cast("long").alias("steps"))


# --- data operations ------------------------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_linenumber % 2 = 0")
def filter_count_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


@query("SELECT conv_id, turn, role, array_to_string(list_filter(list_transform(string_split(replace(text, '<b>', ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS cleaned FROM conversations WHERE text IS NOT NULL")
def line_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", text.clean_lines(F.col("text"), ["<b>"]).alias("cleaned"))


@query(f"WITH {_E}, {_R} SELECT user_id, ((rn - 1) // 4)::BIGINT AS batch, count(*)::BIGINT AS n, min(event_id) AS first_id FROM o GROUP BY ALL")
def queue_batches(spark, sf_dir):
    s = events(spark, sf_dir)
    batch = F.floor((F.row_number().over(s.by_key()) - 1) / 4).cast("long")
    return s.df.withColumn("batch", batch).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


_PREP = "'" + "','".join(text.PREPOSITIONS) + "'"
_TOK = f"""t AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g') AS w FROM documents),
c AS (SELECT doc_id, count(*)::BIGINT AS total_words, count(*) FILTER (w IN ({_PREP}))::BIGINT AS hits, count(DISTINCT w) FILTER (w IN ({_PREP}))::BIGINT AS unique_prepositions FROM t WHERE w <> '' GROUP BY 1),
a AS (SELECT d.doc_id, d.source, coalesce(total_words, 0) AS total_words, coalesce(unique_prepositions, 0) AS unique_prepositions, round(CASE WHEN total_words > 0 THEN hits * 100.0::DOUBLE / total_words ELSE 0 END, 6) AS density
FROM documents d LEFT JOIN c USING (doc_id))"""


@query(f"WITH {_TOK} SELECT doc_id, total_words, unique_prepositions, density FROM a")
def doc_prepositions(spark, sf_dir):
    return text.prepositions(table(spark, sf_dir, "documents")).select("doc_id", "total_words", "unique_prepositions", "density")


@query(f"""WITH {_TOK} SELECT doc_id, source, unique_prepositions, row_number() OVER (PARTITION BY source ORDER BY unique_prepositions DESC, density DESC, doc_id)::BIGINT AS rank FROM a""")
def doc_prepositions_rank(spark, sf_dir):
    """Ranks inside each source, so that no task orders the whole corpus."""
    best = Window.partitionBy("source").orderBy(F.desc("unique_prepositions"), F.desc("density"), "doc_id")
    return text.prepositions(table(spark, sf_dir, "documents")).select("doc_id", "source", "unique_prepositions", F.row_number().over(best).cast("long").alias("rank"))


@query(f"""WITH t AS (SELECT source, regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g') AS w FROM documents), u AS (SELECT DISTINCT source, w FROM t WHERE w IN ({_PREP}))
SELECT source, count(*)::BIGINT AS n_distinct, array_to_string(list_slice(list_sort(list(w)), 1, 10), ' ') AS first_ten FROM u GROUP BY 1""")
def batch_set_union(spark, sf_dir):
    """The union of the prepositions of a source's documents, and ten of them."""
    found = text.prepositions(table(spark, sf_dir, "documents")).select("source", F.explode(F.array_distinct("hits")).alias("w")).distinct()
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_distinct"), F.array_join(F.slice(F.sort_array(F.collect_list("w")), 1, 10), " ").alias("first_ten"))


@query("SELECT count(DISTINCT source)::BIGINT AS n_sources, count(DISTINCT lang)::BIGINT AS n_langs, count(DISTINCT lang || '/' || source)::BIGINT AS n_pairs FROM documents")
def global_distinct(spark, sf_dir):
    """Distinct values over all groups, each group brought down to its own first."""
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    both = F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.struct("lang", "source"))
    return pairs.agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.countDistinct(both).alias("n_pairs"))


@query("SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS shortest, arg_max(doc_id, (n_chars, doc_id)) AS longest FROM documents GROUP BY 1")
def ranking_ends(spark, sf_dir):
    """First and last of a ranking, without ordering it."""
    place = F.struct("n_chars", "doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", place).alias("shortest"), F.max_by("doc_id", place).alias("longest"))


@query("SELECT source, count(*)::BIGINT AS n_docs, round(avg(n_chars), 6) AS avg_chars, count(DISTINCT lang)::BIGINT AS n_langs FROM documents GROUP BY 1")
def mapreduce_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.countDistinct("lang").alias("n_langs"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def mapreduce_top10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("""WITH b AS (SELECT l_orderkey AS auction, l_suppkey AS bidder, l_extendedprice * CASE WHEN l_quantity <= 12 THEN 1.1::DOUBLE WHEN l_quantity <= 25 THEN 1.0::DOUBLE WHEN l_quantity <= 38 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS score FROM lineitem),
m AS (SELECT auction, bidder, max(score) AS score FROM b WHERE score >= 5000 GROUP BY 1, 2)
SELECT auction, bidder, round(score, 4) AS score, row_number() OVER (PARTITION BY auction ORDER BY round(score, 4) DESC, bidder)::BIGINT AS rank FROM m""")
def auction(spark, sf_dir):
    """Bids scored by response time (the quantity stands in), above a floor, best first; rank 1 wins."""
    q = F.col("l_quantity")
    score = F.col("l_extendedprice") * F.when(q <= 12, 1.1).when(q <= 25, 1.0).when(q <= 38, 0.95).otherwise(0.9)
    bids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), score.alias("score")).where("score >= 5000")
    best = bids.groupBy("auction", "bidder").agg(F.round(F.max("score"), 4).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("auction").orderBy(F.desc("score"), "bidder")).cast("long"))


@query("SELECT count(*)::BIGINT AS n, round(coalesce(avg(v), 0), 6) AS mean, coalesce(min(v), 0) AS least, coalesce(max(v), 0) AS greatest FROM (SELECT value * 1.5::DOUBLE AS v FROM events WHERE value > 50)")
def filter_map_stats(spark, sf_dir):
    kept = table(spark, sf_dir, "events").where("value > 50").select((F.col("value") * 1.5).alias("v"))
    zero = F.lit(0.0)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("v"), zero), 6).alias("mean"), F.coalesce(F.min("v"), zero).alias("least"), F.coalesce(F.max("v"), zero).alias("greatest"))


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words, replace(upper(text), 'ẞ', 'SS') AS shouted, strlen(text)::BIGINT AS n_bytes FROM benchmark")
def text_pipeline(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return table(spark, sf_dir, "benchmark").select("item_id", words.alias("n_words"), F.upper("text").alias("shouted"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"""WITH {_E}, p AS (SELECT user_id, us AS t, 1 AS d FROM e UNION ALL SELECT user_id, us + (value * 1000)::BIGINT * 1000000, -1 FROM e),
s AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM p)
SELECT user_id, max(running)::BIGINT AS most_at_once FROM s GROUP BY 1""")
def concurrency_overlap(spark, sf_dir):
    """The most intervals open at once, by a sweep over starts and ends instead of a self-join."""
    length = F.round(F.col("value") * 1000).cast("long") * 1000000
    points = events(spark, sf_dir).df.select("user_id", F.explode(F.array(F.struct(F.col("us").alias("t"), F.lit(1).alias("d")), F.struct((F.col("us") + length).alias("t"), F.lit(-1).alias("d")))).alias("p"))
    along = Window.partitionBy("user_id").orderBy("p.t", "p.d").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("running", F.sum("p.d").over(along)).groupBy("user_id").agg(F.max("running").alias("most_at_once"))


@query("""SELECT vec_id, round(list_sum(v), 6) AS total, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS variance FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""")
def vector_stats(spark, sf_dir):
    return text.vector_stats(table(spark, sf_dir, "embeddings"))


@query("""WITH p AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.pair::BIGINT AS pair, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_sum(a.v) * 0.5::DOUBLE + list_sum(b.v) * 0.5::DOUBLE, 6) AS mid_sum FROM p a JOIN p b ON a.pair = b.pair AND a.side = 0 AND b.side = 1""")
def vector_pairs(spark, sf_dir):
    return text.vector_pairs(table(spark, sf_dir, "embeddings"))


@query("""WITH d AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
f AS (SELECT o.* FROM orders o JOIN d ON o.o_orderkey = d.k WHERE o_orderstatus <> 'F')
SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS balance FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY 1""")
def ledger_balance(spark, sf_dir):
    """The first posting of a (customer, priority) key counts, reverted ones go, accounts without any have 0."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    return recovery.balances(orders, customers)


@query("SELECT c_custkey, substr(c_name, 14) AS name_key FROM customer WHERE starts_with(c_name, 'Customer#0000')")
def key_prefix_strip(spark, sf_dir):
    """Keys with a prefix, without it."""
    return table(spark, sf_dir, "customer").where(F.startswith("c_name", F.lit("Customer#0000"))).select("c_custkey", F.expr("substring(c_name, 14)").alias("name_key"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'count' WHEN contains(p_name, 'cold') THEN 'customer' ELSE 'revenue' END AS kind, starts_with(p_name, 'small') AS small, strlen(p_name)::BIGINT AS n_bytes FROM part""")
def substring_case(spark, sf_dir):
    name = F.col("p_name")
    kind = F.when(F.contains(name, F.lit("widget")), "count").when(F.contains(name, F.lit("cold")), "customer").otherwise("revenue")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.startswith(name, F.lit("small")).alias("small"), F.octet_length(name).cast("long").alias("n_bytes"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE ELSE value END AS v FROM events)
SELECT CASE WHEN isnan(v) OR isinf(v) THEN 'invalid' ELSE 'valid' END AS route, count(*)::BIGINT AS n, round(sum(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END), 2) AS total FROM v GROUP BY 1""")
def finite_route(spark, sf_dir):
    """What is no number, or infinite, goes another way."""
    i = F.col("event_id")
    odd = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).when(i % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    checked = table(spark, sf_dir, "events").select(odd.alias("v")).select(F.when(finite, "valid").otherwise("invalid").alias("route"), F.when(finite, F.col("v")).otherwise(0.0).alias("v"))
    return checked.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""SELECT user_id, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max('{"cursor":' || event_id || ',"k":' || json_extract(props, '$.k')::BIGINT || '}') AS blob FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    """A field read from JSON, and a cursor written as JSON."""
    read = table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json("props", "k long")["k"].alias("k"))
    return read.groupBy("user_id").agg(F.sum("k").alias("total"), F.max(F.to_json(F.struct(F.col("event_id").alias("cursor"), "k"))).alias("blob"))


@query("""WITH p AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT a.pair, list_transform(range(64), lambda x: list_sum(list_transform(range(8), lambda k: a.v[(x // 8) * 8 + k + 1] * b.v[k * 8 + x % 8 + 1]))) AS c FROM p a JOIN p b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
SELECT pair::BIGINT AS pair, round(list_sum(c), 6) AS total, round(list_sum(list_transform(range(8), lambda i: c[i * 9 + 1])), 6) AS trace FROM m""")
def matrix_products(spark, sf_dir):
    """Neighbouring vectors as 8 x 8 matrices, multiplied."""
    return text.matrix_products(table(spark, sf_dir, "embeddings"), 8)


@query("SELECT event_type AS metric, count(*)::BIGINT AS n, row_number() OVER (ORDER BY event_type)::BIGINT AS line FROM events GROUP BY 1")
def metrics_report(spark, sf_dir):
    """The report in order of its keys; there are as many rows as metrics."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("line", F.row_number().over(Window.orderBy("metric")).cast("long")).orderBy("metric")


@query("SELECT o_orderkey, (k - 1)::INTEGER AS item, o_totalprice * k AS amount FROM orders, range(1, 4) r(k) WHERE k <= o_orderkey % 3 + 1")
def batch_load_items(spark, sf_dir):
    """A table function: each order gives one to three items."""
    loaded = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))).alias("item"))
    return loaded.select("o_orderkey", "item", (F.col("o_totalprice") * (F.col("item") + 1)).alias("amount"))
