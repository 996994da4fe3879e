"""Split and join: parallel branches of a group and the six ways to complete.

A branch table has a row for each branch with its finishing place, finishing time and
outcome. The early-exit strategies leave branches that would have finished later cancelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strategies and the parameter each takes.
STRATEGIES = ("all", "any", "quorum", "percentage", "partial_results", "partial_timeout")


def validate(strategy: str, parameter: float | None, timeout: int | None = None, bulkhead: int | None = None) -> None:
    """Rejects what registration would reject."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "percentage" and not (parameter is not None and 0 < parameter <= 1):
        raise ValueError("a percentage is over 0 and at most 1")
    if strategy == "partial_timeout" and timeout is None:
        raise ValueError("partial_timeout needs a timeout")
    if bulkhead is not None and bulkhead < 1:
        raise ValueError("a bulkhead admits at least one branch")


def satisfied(strategy: str, successes: int, completed: int, total: int, parameter: float = 0) -> bool:
    """Whether a finished split meets its strategy."""
    import math

    need = {"all": total, "any": 1, "quorum": parameter, "percentage": math.ceil(total * parameter), "partial_results": parameter, "partial_timeout": 1}[strategy]
    return (completed if strategy == "partial_timeout" else successes) >= need


def complete(branches: DataFrame, strategy: str, parameter: float = 0, group: str = "grp") -> DataFrame:
    """(group, successes, errors, cancelled, satisfied) from (group, place, finished_at, ok, deadline)."""
    validate(strategy, parameter, 0)
    before = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    wins_before = F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0))
    seen = {
        "any": wins_before < 1,
        "partial_results": wins_before < F.lit(parameter),
        "partial_timeout": F.col("finished_at") <= F.col("deadline"),
    }.get(strategy, F.lit(True))
    marked = branches.withColumn("__seen", seen)
    total, wins = F.count(F.lit(1)), F.count_if(F.col("__seen") & F.col("ok"))
    need = {"all": total, "percentage": F.ceil(total * F.lit(float(parameter))), "any": F.lit(1), "partial_timeout": F.lit(1)}.get(strategy, F.lit(parameter))
    reached = F.count_if("__seen") if strategy == "partial_timeout" else wins
    return marked.groupBy(group).agg(
        wins.alias("successes"), F.count_if(F.col("__seen") & ~F.col("ok")).alias("errors"), F.count_if(~F.col("__seen")).alias("cancelled"), (reached >= need).alias("satisfied")
    )
