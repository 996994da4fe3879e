"""Batches over tables: a slot for every item, with its output or its error, and what finishing makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The category of an item's own error.
FAILED, TIMEOUT, MISSING = "task_execution", "timeout", "key_not_found"


def slots(items: DataFrame, keep: list[str], error: Column, value: Column) -> DataFrame:
    """(keep..., value, error): the value where there is no error."""
    return items.select(*keep, F.when(error.isNull(), value).alias("value"), error.alias("error"))


def failing(ok: Column, category: str = FAILED) -> Column:
    """The error of items that are not ok."""
    return F.when(~ok, category)


def late(seconds: Column, limit: float) -> Column:
    """The error of items whose attempt takes longer than it may."""
    return F.when(seconds > limit, TIMEOUT)


def finish(slotted: DataFrame, by: str) -> DataFrame:
    """Items that succeeded and failed, and the sum of what succeeded."""
    ok = F.col("error").isNull()
    return slotted.groupBy(by).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("ok_sum"))


def attempts(failures: Column, allowed: int) -> tuple[Column, Column]:
    """How often an item that fails so many times first is tried, and whether it succeeds."""
    return F.least(failures + 1, F.lit(allowed)).cast("long"), failures < allowed


def lookup(items: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` of the row with the same key, or the error of a missing key."""
    found = items.join(table.select(key, F.col(value), F.lit(True).alias("__found")), key, "left")
    return found.withColumn("error", F.when(F.col("__found").isNull(), MISSING)).drop("__found")
