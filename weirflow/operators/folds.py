"""Sequential folds: state machines run over each key's rows in order.

A key's rows are brought together and sorted by one shuffle; then a partition is
streamed in Arrow batches with the state of the current key alone in memory, so a key of
any size never has to fit into memory. The same step functions drive the live forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weirflow.plans.runtime import ship


def fold(df: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable, columns: list[str], schema: str) -> DataFrame:
    """``step(state, *values)`` gives the new state and a tuple for ``schema`` after (key, order).

    Values arrive as Python values, with None for null; rows with a null key are one key.
    """
    ship(df.sparkSession)
    types = dict(df.dtypes)
    values = [f"__v{i}" for i in range(len(columns))]
    picked = df.select(df[key].alias(key), df[order].alias(order), *[df[c].alias(v) for c, v in zip(columns, values, strict=True)])
    sorted_rows = picked.repartition(key).sortWithinPartitions(key, order)
    made = to_arrow_schema(StructType.fromDDL(schema))
    nobody = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, nobody
        for batch in batches:
            out = []
            keys, *rest = [batch.column(i).to_pylist() for i in (0, *range(2, batch.num_columns))]
            for row in zip(keys, *rest, strict=True):
                if current is nobody or row[0] != current:
                    state, current = start(), row[0]
                state, emitted = step(state, *row[1:])
                out.append(emitted)
            columns_out = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns_out], names=[key, order, *made.names])

    return sorted_rows.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, {schema}")


# --- circuit breaker ---------------------------------------------------------------------

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def breaker_step(threshold: int, cooldown: int, trials: int = 1):
    """Sequential calls: (state, count, opened_at), where the count is of failures in a row, or of trials won when half open.

    A half-open breaker closes when all its trials are won and opens at the first that fails.
    """

    def step(state, at: int, failed: bool):
        mode, count, opened = state
        if mode == OPEN:
            if at - opened < cooldown:
                return state, (False, OPEN)
            mode, count = HALF_OPEN, 0
        if failed:
            if mode == HALF_OPEN or count + 1 >= threshold:
                return (OPEN, 0, at), (True, OPEN)
            return (CLOSED, count + 1, opened), (True, CLOSED)
        if mode == HALF_OPEN and count + 1 < trials:
            return (HALF_OPEN, count + 1, opened), (True, HALF_OPEN)
        return (CLOSED, 0, opened), (True, CLOSED)

    return step


# --- rate limiters, in whole microseconds and token units -----------------------------------


def bucket_step(capacity: int, micros_per_token: int):
    """Token bucket in microseconds of credit: starts full, refills continuously; costs in tokens."""
    full = capacity * micros_per_token

    def step(state, at: int, cost: int):
        credit, last = state if state else (full, at)
        credit = min(full, credit + max(0, at - last))
        need = cost * micros_per_token
        admitted = cost == 0 or need <= credit
        if admitted:
            credit -= need
        return (credit, at), (admitted, credit)

    def wait(state, at: int, cost: int) -> int:
        """Microseconds until the cost is admitted, from the state of a refusal at this instant."""
        return cost * micros_per_token - state[0]

    step.wait = wait
    return step


def window_step(limit: int, length: int):
    """Fixed window that starts anew at the first call after it ran out."""

    def step(state, at: int, cost: int):
        start, used = state if state else (at, 0)
        if at - start >= length:
            start, used = at, 0
        admitted = cost == 0 or used + cost <= limit
        if admitted:
            used += cost
        return (start, used), (admitted, used)

    step.wait = lambda state, at, cost: state[0] + length - at
    return step


#: A refused call is tried again after a millisecond at least.
LEAST_WAIT = 1000


def multi_step(*tiers):
    """Tiers debited in order, all or nothing; the first that refuses is named (from 1, 0 for none) with the microseconds until it might not.

    ``only`` may name the tiers of a call (from 1); others are left as they are.
    """

    def step(state, at: int, cost: int, only: Sequence[int] | None = None):
        held = list(state) if state else [None] * len(tiers)
        kept = [tier(s, at, 0)[0] for tier, s in zip(tiers, held, strict=True)]
        new = list(kept)
        for k, tier in enumerate(tiers):
            if only and k + 1 not in only:
                continue
            new[k], (ok, _) = tier(kept[k], at, cost)
            if not ok:
                return tuple(kept), (False, k + 1, max(tier.wait(new[k], at, cost), LEAST_WAIT))
        return tuple(new), (True, 0, 0)

    return step


def hysteresis_step(high: float, low: float):
    """Alert from ``high`` on, calm again from ``low`` down."""

    def step(alert: bool, value: float):
        alert = value > low if alert else value >= high
        return alert, ("alert" if alert else "calm",)

    return step


def mode_windows_step(high: float, low: float, calm: int, alert: int):
    """Windows of ``calm`` items, and of ``alert`` items once a window's greatest value has reached ``high``, until one's stays down to ``low``.

    The state is (alert, window, items held, their greatest value); each item is emitted with its window and the mode.
    """

    def step(state, value: float):
        on, window, held, top = state
        if held >= (alert if on else calm):
            on, window, held, top = (top > low if on else top >= high), window + 1, 0, None
        top = value if top is None else max(top, value)
        return (on, window, held + 1, top), (window, "alert" if on else "calm", value)

    return step


def negotiation_step(floor: int, rounds: int, hopeless: float):
    """Offers drop by each row's reduction until they fit the budget (deal) or are hopeless after many rounds."""

    def step(state, opening: int, budget: int, reduction: int):
        turn, offer, end = state
        if end:
            return state, (turn, offer, end)
        turn += 1
        offer = opening if turn == 1 else max(offer - reduction, floor)
        if offer <= budget:
            end = "deal"
        elif turn >= rounds and offer / budget > hopeless:
            end = "no_deal"
        return (turn, offer, end), (turn, offer, end)

    return step
