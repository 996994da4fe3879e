"""Windows over a stream, with the same windows as the replay form on the same input.

A window is kept as state until it is full; what is still open when the input ends, the tail,
is read from the state that the last micro-batch left in the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirflow.flow.stages import FAIL_FAST, SKIP, Count, Duration
from weirflow.plans.runtime import ship

_STATE = "window long, held long, top double, has_top boolean, cursor long, streak long, failed boolean, opened long, keyed boolean"


def greater(a: float | None, b: float | None) -> float | None:
    """The greater value as aggregates see it: nulls do not count, NaN is above all."""
    if a is None or b is None:
        return b if a is None else a
    return a if math.isnan(a) or a >= b else b


def windows(stream: DataFrame, key: str, order: str, value: str, window: Count | Duration, on_error: str | int = SKIP, time: str | None = None) -> DataFrame:
    """(key, window, n, max_value, cursor) of each window as it ends, from items with a whole-number ``order`` and an ``ok`` flag.

    Failed items are dropped; with ``fail_fast``, or more errors in a row than the number given, a key ends at
    its failure and its open window is not flushed. Duration windows count from the key's first item by the
    column ``time`` in microseconds; an item at a window's end is in the next one. Rows of a micro-batch are put in order.
    """
    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)
    limit = max(1, window.n) if isinstance(window, Count) else None
    length = max(1, int(window.seconds * 1e6)) if isinstance(window, Duration) else None
    if length and time is None:
        raise ValueError("duration windows need a time column")
    budget = None if on_error == SKIP else 0 if on_error == FAIL_FAST else int(on_error)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            at, held, top, has_top, cursor, streak, failed, opened, keyed = state.get
            top = top if has_top else None
        else:
            at, held, top, cursor, streak, failed, opened, keyed = 0, 0, None, 0, 0, False, 0, False
        out = []
        rows = pd.concat(list(parts)).sort_values(order)
        columns = [rows[order], rows["__value"], rows["__null"], rows["__ok"], rows["__time"]]
        for o, v, null, ok, t in zip(*(c.tolist() for c in columns), strict=True):
            if failed:
                break
            if not keyed:
                opened, keyed = t, True
            if not ok:
                streak += 1
                failed = budget is not None and streak > budget
                continue
            streak = 0
            if length and (t - opened) // length != at:
                if held:
                    out.append((k[0], at, held, top, cursor))
                at, held, top = (t - opened) // length, 0, None
            held, cursor, top = held + 1, o, greater(top, None if null else v)
            if limit and held == limit:
                out.append((k[0], at, held, top, cursor))
                at, held, top = at + 1, 0, None
        state.update((int(at), int(held), float(top or 0.0), top is not None, int(cursor), int(streak), bool(failed), int(opened), bool(keyed)))
        yield pd.DataFrame(out, columns=[key, "window", "n", "max_value", "cursor"])

    narrow = stream.select(
        key, order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__value"), F.col(value).isNull().alias("__null"), F.coalesce("ok", F.lit(False)).alias("__ok"),
        (F.col(time) if time else F.lit(0)).cast("long").alias("__time"),
    )
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, window long, n long, max_value double, cursor long", _STATE, "append", GroupStateTimeout.NoTimeout)


def count_windows(stream: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Windows of ``n`` successful items."""
    return windows(stream, key, order, value, Count(n))


def drain(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes all that is there and ends; a rerun with the same checkpoint goes on after it."""
    q = result.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def tail(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The windows still open at the end of the input, as the stream's last micro-batch left them; failed keys flush none."""
    held = spark.read.format("statestore").load(checkpoint)
    state = "value.groupState" if "groupState" in held.select("value.*").columns else "value"
    s = held.select(F.col("key").getField(held.select("key.*").columns[0]).alias(key), F.col(f"{state}.*"))
    return s.where("held > 0 and not failed").select(key, "window", F.col("held").alias("n"), F.when(F.col("has_top"), F.col("top")).alias("max_value"), "cursor")
