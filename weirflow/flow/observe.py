"""Observers of runs: hooks, a logger, metrics."""

from __future__ import annotations

import logging
import threading
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

HOOKS = (
    "state_enter", "task_start", "task_success", "task_failure", "retry", "circuit_open", "checkpoint", "resume",
    "workflow_timeout", "cancelled", "checkpoint_clear_failed", "unknown_resume_state",
)


class Observer:
    """Every hook does nothing; hooks are called in order of registration and their errors never stop a run."""

    def on_state_enter(self, state: str) -> None: ...

    def on_task_start(self, task: str) -> None: ...

    def on_task_success(self, task: str) -> None: ...

    def on_task_failure(self, task: str, error: Exception) -> None: ...

    def on_retry(self, task: str, attempt: int) -> None: ...

    def on_circuit_open(self, task: str) -> None: ...

    def on_checkpoint(self, run: str, sequence: int) -> None: ...

    def on_resume(self, run: str, sequence: int) -> None: ...

    def on_workflow_timeout(self, elapsed: float, limit: float) -> None: ...

    def on_cancelled(self, state: str) -> None: ...

    def on_checkpoint_clear_failed(self, run: str, error: Exception) -> None: ...

    def on_unknown_resume_state(self, run: str, state: str) -> None: ...


def tell(observers: Iterable, hook: str, *args) -> None:
    """To observers, and to plain functions as (event, first argument), where entering a state is ``enter``."""
    for o in observers:
        try:
            if isinstance(o, Observer):
                getattr(o, f"on_{hook}")(*args)
            else:
                o("enter" if hook == "state_enter" else hook, args[0] if args else None)
        except Exception:  # noqa: BLE001, S110
            pass


class TracingObserver(Observer):
    """Writes each hook to a logger."""

    def __init__(self, logger: logging.Logger | None = None, level: int = logging.INFO) -> None:
        self.logger, self.level = logger or logging.getLogger("weirflow"), level


class RecordingObserver(Observer):
    """Keeps (hook, arguments) in order."""

    def __init__(self) -> None:
        self.events: list[tuple] = []
        self._lock = threading.Lock()

    def record(self, *event) -> None:
        with self._lock:
            self.events.append(event)

    def path(self) -> list[str]:
        return [e[1] for e in self.events if e[0] == "state_enter"]

    def count(self, hook: str) -> int:
        return sum(e[0] == hook for e in self.events)


def _forward(hook: str, to: Callable) -> Callable:
    def call(self, *args) -> None:
        to(self, hook, args)

    call.__name__ = f"on_{hook}"
    return call


for _hook in HOOKS:
    setattr(TracingObserver, f"on_{_hook}", _forward(_hook, lambda self, hook, args: self.logger.log(self.level, "%s %s", hook, args)))
    setattr(RecordingObserver, f"on_{_hook}", _forward(_hook, lambda self, hook, args: self.record(hook, *args)))


class Metrics:
    """Counters, gauges and histograms by name and label."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.counters: Counter = Counter()
        self.gauges: Counter = Counter()
        self.histograms: dict[tuple[str, str], list[float]] = defaultdict(list)

    def add(self, name: str, label: str = "", n: float = 1) -> None:
        with self._lock:
            self.counters[name, label] += n

    def gauge(self, name: str, change: float, label: str = "") -> None:
        with self._lock:
            self.gauges[name, label] += change

    def observe(self, name: str, value: float, label: str = "") -> None:
        with self._lock:
            self.histograms[name, label].append(value)

    def timed(self, name: str, label: str = "") -> _Timer:
        return _Timer(self, name, label)

    def rows(self) -> list[tuple[str, str, str, float, float]]:
        """(kind, name, label, count, sum), by name and label."""
        with self._lock:
            out = [("counter", n, v, float(c), float(c)) for (n, v), c in self.counters.items()]
            out += [("gauge", n, v, 1.0, float(c)) for (n, v), c in self.gauges.items()]
            out += [("histogram", n, v, float(len(x)), float(sum(x))) for (n, v), x in self.histograms.items()]
        return sorted(out, key=lambda r: (r[1], r[2]))

    def frame(self, spark):
        return spark.createDataFrame(self.rows(), "kind string, name string, label string, n double, total double")


class _Timer:
    def __init__(self, metrics: Metrics, name: str, label: str) -> None:
        self.metrics, self.name, self.label = metrics, name, label

    def __enter__(self) -> _Timer:
        self.began = time.monotonic()
        return self

    def __exit__(self, *_) -> None:
        self.metrics.observe(self.name, time.monotonic() - self.began, self.label)


#: What the engine itself counts, whether or not anyone observes.
ENGINE = Metrics()


class MetricsObserver(Observer):
    """Counts hooks: states entered, runs of tasks by outcome, retries, open circuits, checkpoints, resumes, timeouts, cancellations."""

    def __init__(self, metrics: Metrics | None = None) -> None:
        self.metrics = metrics or Metrics()

    def on_state_enter(self, state: str) -> None:
        self.metrics.add("state_enters_total", state)

    def on_task_success(self, task: str) -> None:
        self.metrics.add("observed_task_runs_total", "success")

    def on_task_failure(self, task: str, error: Exception) -> None:
        self.metrics.add("observed_task_runs_total", "failure")

    def on_retry(self, task: str, attempt: int) -> None:
        self.metrics.add("task_retries_total", task)

    def on_circuit_open(self, task: str) -> None:
        self.metrics.add("circuit_open_events_total", task)

    def on_checkpoint(self, run: str, sequence: int) -> None:
        self.metrics.add("checkpoints_observed_total")

    def on_resume(self, run: str, sequence: int) -> None:
        self.metrics.add("resumes_total")

    def on_workflow_timeout(self, elapsed: float, limit: float) -> None:
        self.metrics.add("observed_workflow_timeouts_total")
        self.metrics.observe("observed_workflow_timeout_limit_seconds", limit)
        self.metrics.observe("observed_workflow_timeout_elapsed_seconds", elapsed)

    def on_cancelled(self, state: str) -> None:
        self.metrics.add("observed_cancellations_total", state)

    def on_unknown_resume_state(self, run: str, state: str) -> None:
        self.metrics.add("observed_unknown_resume_states_total")
