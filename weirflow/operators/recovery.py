"""Checkpoint logs as tables: what to undo, where to resume, which appends clash.

A log has (workflow_id, sequence, state, task_id, kind, blob, workflow_version); kind 0 is
a state entry, 1 a completed step that can be undone, 2 a cursor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY, COMPLETION, CURSOR = 0, 1, 2


def _before_failure(log: DataFrame, fails: Column) -> DataFrame:
    first = F.min(F.when(fails, F.col("sequence"))).over(Window.partitionBy("workflow_id"))
    return log.withColumn("failed_at", first).where("failed_at is not null")


def rollback(log: DataFrame, fails: Column) -> DataFrame:
    """Completed steps before the first failure, last first."""
    done = _before_failure(log, fails).where((F.col("kind") == COMPLETION) & (F.col("sequence") < F.col("failed_at")))
    order = F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc("sequence"))).cast("long")
    return done.select("workflow_id", "sequence", "task_id", order.alias("undo_order"))


def outcome(log: DataFrame, fails: Column, undo_fails: Column) -> DataFrame:
    """What a rollback leaves: the original error, a cleared log, or a failed compensation."""
    undone = (F.col("kind") == COMPLETION) & (F.col("sequence") < F.col("failed_at"))
    runs = _before_failure(log, fails).groupBy("workflow_id").agg(F.count_if(undone).alias("undone"), F.count_if(undone & undo_fails).alias("failed"))
    return runs.withColumn("outcome", F.when(F.col("undone") == 0, "original_error").when(F.col("failed") == 0, "rolled_back").otherwise("compensation_failed"))


def resume_point(log: DataFrame) -> DataFrame:
    """The last row decides the state; numbering goes on after it."""
    return log.groupBy("workflow_id").agg(F.max_by("state", "sequence").alias("state"), (F.max("sequence") + 1).alias("start_sequence"))


def cursors(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == CURSOR).groupBy("workflow_id", "state").agg(F.max_by("blob", "sequence").alias("cursor"))


def stack(log: DataFrame) -> DataFrame:
    """Completed steps but for the row the run resumes from."""
    last = F.max("sequence").over(Window.partitionBy("workflow_id"))
    return log.withColumn("last", last).where((F.col("kind") == COMPLETION) & (F.col("sequence") != F.col("last"))).select("workflow_id", "sequence", "task_id", "blob")


def path(log: DataFrame) -> DataFrame:
    """State entries before the resumed state's own last entry."""
    run = Window.partitionBy("workflow_id")
    marked = log.withColumn("resume", F.max_by("state", "sequence").over(run)).withColumn("last", F.max("sequence").over(run))
    entered = F.max(F.when((F.col("kind") == ENTRY) & (F.col("state") == F.col("resume")), F.col("sequence"))).over(run)
    kept = marked.withColumn("cutoff", F.coalesce(entered, F.col("last") + 1)).where((F.col("kind") == ENTRY) & (F.col("sequence") < F.col("cutoff")))
    return kept.select("workflow_id", "sequence", "state")


def conflicts(log: DataFrame, arrival: str) -> DataFrame:
    """Appends that meet a taken (workflow, sequence): the first is kept."""
    return log.groupBy("workflow_id", "sequence").agg(F.min(arrival).alias("kept"), (F.count(F.lit(1)) - 1).alias("rejected")).where("rejected > 0")


def balances(orders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Idempotent postings summed by account."""
    first = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min_by(F.struct("o_orderstatus", "o_totalprice"), "o_orderkey").alias("p"))
    kept = first.where("p.o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("p.o_totalprice").alias("s"))
    return accounts.join(kept, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("balance"))
