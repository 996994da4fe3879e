"""Helpers for testing workflows: recorded hooks, stages that fail on purpose, resources that count."""

from __future__ import annotations

import threading
from collections.abc import Callable

from weirflow.flow.errors import CheckpointConflict
from weirflow.flow.log import COMPLETION, MemoryLog, Row
from weirflow.flow.observe import RecordingObserver

__all__ = ["RecordingObserver", "FailOn", "FailingLog", "CountedResource", "assert_path", "assert_undone"]


class FailOn:
    """Calls through, but raises on the given attempts (from 1)."""

    def __init__(self, f: Callable, *attempts: int, error: Callable[[], Exception] = lambda: RuntimeError("on purpose")) -> None:
        self.f, self.attempts, self.error, self.calls, self._lock = f, set(attempts), error, 0, threading.Lock()

    def __call__(self, *args):
        with self._lock:
            self.calls += 1
            now = self.calls
        if now in self.attempts:
            raise self.error()
        return self.f(*args)


class FailingLog(MemoryLog):
    """A log that refuses the appends with the given sequence numbers, or to be cleared."""

    def __init__(self, *sequences: int, clear: bool = True) -> None:
        super().__init__()
        self.refused, self.clears = set(sequences), clear

    def append(self, run: str, row: Row) -> None:
        if row.sequence in self.refused:
            raise CheckpointConflict(f"row {row.sequence} is refused")
        super().append(run, row)

    def clear(self, run: str) -> None:
        if not self.clears:
            raise OSError("the log cannot be cleared")
        super().clear(run)


class CountedResource:
    """Notes its set-up and tear-down in a shared list."""

    def __init__(self, name: str, events: list, fails: bool = False, health: str = "healthy") -> None:
        self.name, self.events, self.fails, self._health = name, events, fails, health

    def setup(self) -> None:
        if self.fails:
            raise RuntimeError(f"{self.name} cannot be set up")
        self.events.append(f"up {self.name}")

    def teardown(self) -> None:
        self.events.append(f"down {self.name}")

    def health(self) -> str:
        return self._health


def assert_path(observer: RecordingObserver, *states: str) -> None:
    """The states entered, in order."""
    assert observer.path() == list(states), observer.path()


def assert_undone(undone: list, log: MemoryLog, run: str = "run") -> None:
    """Outputs were undone in the reverse order of their completion rows, or of all completed steps if the log is cleared."""
    rows = [r for r in log.load(run) if r.kind == COMPLETION]
    assert undone, "nothing was undone"
    if rows:
        import json

        assert undone == [json.loads(r.blob) for r in reversed(rows)], undone
