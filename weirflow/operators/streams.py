"""Windowed stream processing over a static, ordered table.

A stream is a table with a key, a total order inside the key and an ``ok`` flag for each
item. Windows hold successful items only; a cursor is the order value of a window's last
item. Every key is independent, so all plans are one shuffle on the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stream:
    """Items of ``df`` by ``key`` in the order of ``order``; failed where ``ok`` is false."""

    df: DataFrame
    key: str
    order: str
    ok: Column

    def by_key(self, upto: bool = False):
        w = Window.partitionBy(self.key).orderBy(self.order)
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto else w

    def good(self) -> DataFrame:
        return self.df.where(self.ok)

    def since(self, cursor: DataFrame) -> Stream:
        """The items after each key's ``cursor``; keys without one start from their first item."""
        later = self.df.join(cursor.select(self.key, "cursor"), self.key, "left").where(F.col("cursor").isNull() | (F.col(self.order) > F.col("cursor"))).drop("cursor")
        return Stream(later, self.key, self.order, self.ok)


def count_windows(s: Stream, n: int) -> DataFrame:
    """Adds ``window``: every ``max(n, 1)`` successful items of a key."""
    at = F.row_number().over(s.by_key()) - 1
    return s.good().withColumn("window", F.floor(at / max(n, 1)).cast("long"))


def duration_windows(s: Stream, time: Column, length: int) -> DataFrame:
    """Adds ``window``: half-open stretches of ``length`` counted from the key's first item; empty ones do not occur."""
    opened = F.min("__t").over(Window.partitionBy(s.key))
    timed = s.df.withColumn("__t", time).withColumn("__t0", opened).where(s.ok)
    return timed.withColumn("window", F.floor((F.col("__t") - F.col("__t0")) / max(length, 1)).cast("long")).drop("__t", "__t0")


def flush(windows: DataFrame, s: Stream, value: str) -> DataFrame:
    """One row a window: items, greatest value and the cursor to commit."""
    return windows.groupBy(s.key, "window").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), F.max(s.order).alias("cursor"))


def fail_fast(s: Stream, n: int) -> DataFrame:
    """For each key, windows flushed before the first failed item, their cursor, and whether it failed; one shuffle."""
    failed = F.sum((~s.ok).cast("int")).over(s.by_key(upto=True))
    seen = s.df.withColumn("__failed", failed).withColumn("__at", F.row_number().over(s.by_key()))
    before, broken = F.col("__failed") == 0, F.max("__failed") > 0
    good = F.count_if(before)
    full, last = (F.max(F.when(c, F.col(s.order))) for c in (before & (F.col("__at") % n == 0), before))
    return seen.groupBy(s.key).agg(
        F.when(broken, F.floor(good / n)).otherwise(F.ceil(good / n)).cast("long").alias("windows"), F.when(broken, full).otherwise(last).alias("cursor"), broken.alias("failed")
    )


def skip_and_continue(s: Stream, n: int) -> DataFrame:
    """For each key, windows flushed, items kept and items dropped."""
    kept = F.count_if(s.ok)
    return s.df.groupBy(s.key).agg(F.ceil(kept / n).cast("long").alias("windows"), kept.alias("kept"), F.count_if(~s.ok).alias("dropped"))


def hysteresis(s: Stream, value: str, high: float, low: float) -> DataFrame:
    """(key, order, mode): alert from ``high`` on, calm again from ``low`` down; the last value that decided holds."""
    flips = F.when(F.col(value) >= high, True).when(F.col(value) <= low, False)
    alert = F.coalesce(F.last(flips, ignorenulls=True).over(s.by_key(upto=True)), F.lit(False))
    return s.df.select(s.key, s.order, F.when(alert, "alert").otherwise("calm").alias("mode"))


def poll(s: Stream, ready: Column, most_errors: int) -> DataFrame:
    """For each key, the polls until one is ready or more errors than allowed came in a row, and which it was.

    A poll that is neither ready nor an error is pending and clears the errors in a row.
    """
    island = F.sum(s.ok.cast("int")).over(s.by_key(upto=True))
    marked = s.df.withColumn("__at", F.row_number().over(s.by_key()).cast("long")).withColumn("__good", island)
    streak = F.sum((~s.ok).cast("int")).over(Window.partitionBy(s.key, "__good").orderBy(s.order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = F.when(s.ok & ready, F.struct("__at", F.lit("ready").alias("outcome"), F.col(s.order).alias("ended_at"))).when(
        streak > most_errors, F.struct("__at", F.lit("failed").alias("outcome"), F.col(s.order).alias("ended_at"))
    )
    first = marked.withColumn("__end", ends).groupBy(s.key).agg(F.min("__end").alias("e"), F.max("__at").alias("n"))
    return first.select(s.key, F.coalesce("e.__at", "n").alias("polls"), F.coalesce("e.outcome", F.lit("pending")).alias("outcome"), F.col("e.ended_at").alias("ended_at"))


def error_budget(s: Stream, most: int) -> DataFrame:
    """For each key, the item at which more than ``most`` errors came in a row (null if none) and the successes before it."""
    island = F.sum(s.ok.cast("int")).over(s.by_key(upto=True))
    marked = s.df.withColumn("__good", island)
    streak = F.sum((~s.ok).cast("int")).over(Window.partitionBy(s.key, "__good").orderBy(s.order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marked.withColumn("__streak", streak)
    over = F.col("__streak") > most
    return counted.groupBy(s.key).agg(F.min(F.when(over, F.col(s.order))).alias("failed_at"), F.coalesce(F.min(F.when(over, F.col("__good"))), F.max("__good")).alias("processed"))


def until_stop(windows: DataFrame, s: Stream, stops: Column) -> DataFrame:
    """Windows up to and with the first that asks to stop; its cursor is still committed."""
    before = Window.partitionBy(s.key).orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.max(stops.cast("int")).over(before), F.lit(0))
    return windows.withColumn("__asked", asked).where("__asked = 0").withColumn("stopped", stops).drop("__asked")


def cursor_log(windows: DataFrame, s: Stream) -> DataFrame:
    """A dense sequence of commits by key."""
    seq = F.row_number().over(Window.partitionBy(s.key).orderBy("window")).cast("long")
    return windows.select(s.key, seq.alias("sequence"), "window", "cursor")
