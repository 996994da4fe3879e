"""Stores, resources and graphs as tables: what a log of writes leaves, how healthy a group is, where edges lead nowhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.flow.store import HEALTH


def last_write(log: DataFrame, key: str, order: str, value: Column, removed: Column) -> DataFrame:
    """(key, value) of what is there in the end: the last write wins, a removal takes the key away."""
    last = log.groupBy(key).agg(F.max_by(F.struct(value.alias("value"), removed.alias("removed")), order).alias("w"))
    return last.where("not w.removed").select(key, F.col("w.value").alias("value"))


def appended(log: DataFrame, key: str, order: str, value: str, separator: str = ",") -> DataFrame:
    """(key, appended): the values of a key's list in the order of their appends. A key's list is one value, as in the store."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return log.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[value]), separator).alias("appended"))


def health(resources: DataFrame, group: str, name: str, severity: Column) -> DataFrame:
    """(group, health, resource): the worst health of a group, and of equals the first resource."""
    rated = resources.select(group, F.col(name).alias("resource"), severity.alias("severity"))
    worst = rated.groupBy(group).agg(F.max_by(F.struct("severity", "resource"), F.struct("severity", -F.col("resource"))).alias("w"))
    names = F.array(*map(F.lit, HEALTH))
    return worst.select(group, F.element_at(names, F.col("w.severity") + 1).alias("health"), F.col("w.resource").alias("resource"))


def histogram(values: DataFrame, name: str, value: str) -> DataFrame:
    """(metric, n, total, greatest) of each metric's observations."""
    return values.groupBy(F.col(name).alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"), F.max(value).alias("greatest"))


def dangling(edges: DataFrame, states: Sequence[str]) -> DataFrame:
    """(from_state, missing): different edges that lead to no registered state."""
    known = edges.sparkSession.createDataFrame([(s,) for s in states], "missing string")  # as many rows as the graph has states
    return edges.distinct().join(F.broadcast(known), "missing", "left_anti").select("from_state", "missing")
