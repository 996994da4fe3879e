"""Schedules as columns: retry pauses, back-off, runs a fixed time apart, and cron instants.

The parameters are the objects that the driver's own loops use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from weirflow.flow.resilience import Retry
from weirflow.flow.schedule import Backoff, Cron

_DAY = 86_400
#: Days looked ahead at first, and at most.
_NEAR, _FAR = 400, 3300


def retry_delay(retry: Retry, attempt: Column, base: Column | None = None) -> Column:
    """Milliseconds to wait after the attempt (from 0), without jitter; ``base`` may differ from row to row."""
    factor = retry.factor if retry.factor > 0 else 1.0
    start = F.lit(float(retry.base)) if base is None else base.cast("double")
    d = F.least(start * F.pow(F.lit(float(factor)), attempt), F.lit(float(retry.most)))
    return F.when(start > 0, F.greatest(d, F.lit(1.0))).otherwise(d)


def backoff_delay(policy: Backoff, streak: Column) -> Column:
    """Seconds to keep still after so many failures in a row, without jitter; none after a success."""
    d = F.least(F.lit(policy.initial) * F.pow(F.lit(policy.factor), streak - 1), F.lit(policy.most))
    return F.when(streak > 0, d).otherwise(0.0)


def tripped(policy: Backoff, streak: Column) -> Column:
    return F.lit(False) if policy.limit is None else streak >= policy.limit


def fixed_delay_start(key: str, order: str, took: Column, pause: int) -> Column:
    """When each run starts, if the next begins ``pause`` after the one before has ended and the first at 0."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(took + pause).over(before), F.lit(0))


def next_cron(expression: str, us: Column) -> Column:
    """Microseconds of the first instant after ``us`` at which the expression fires (UTC); null if it does not within nine years."""
    c = Cron.parse(expression)
    wanted = F.floor(us / 1_000_000).cast("long") + 1
    day = F.floor(wanted / _DAY).cast("long")
    at = _time_of_day(c, (wanted - day * _DAY).cast("long"))
    today = F.when(_fits(c, day) & at.isNotNull(), day * _DAY + at)
    first = _hms(*(min(x) for x in (c.hours, c.minutes, c.seconds)))
    every = len(c.days) == 31 and len(c.months) == 12 and len(c.weekdays) == 7
    if every:
        later = day + 1
    else:
        search = lambda a, b: F.array_min(F.filter(F.sequence(day + a, day + b), lambda d: _fits(c, d)))
        later = F.coalesce(search(1, _NEAR), search(_NEAR + 1, _FAR))
    return F.coalesce(today, later * _DAY + first) * 1_000_000


def _hms(h, m, s):
    return (h * 60 + m) * 60 + s


def _fits(c: Cron, day: Column) -> Column:
    """Whether a day, counted from 1970, is one of the expression's."""
    date = F.date_from_unix_date(day.cast("int"))
    return F.dayofmonth(date).isin(*c.days) & F.month(date).isin(*c.months) & (F.dayofweek(date) - 1).isin(*c.weekdays)


def _least(values: Sequence[int], least: Column) -> Column:
    return F.array_min(F.filter(F.array(*map(F.lit, sorted(values))), lambda v: v >= least))


def _time_of_day(c: Cron, wanted: Column) -> Column:
    """The first second of the day from ``wanted`` on that fits."""
    h, m, s = F.floor(wanted / 3600), F.floor(wanted / 60) % 60, wanted % 60
    in_hour, in_minute = h.isin(*c.hours), m.isin(*c.minutes)
    second, minute, hour = _least(c.seconds, s), _least(c.minutes, m + 1), _least(c.hours, h + 1)
    return F.coalesce(
        F.when(in_hour & in_minute, _hms(h, m, second)),
        F.when(in_hour, _hms(h, minute, F.lit(min(c.seconds)))),
        _hms(hour, F.lit(min(c.minutes)), F.lit(min(c.seconds))),
    ).cast("long")
