"""Cancellation and deadlines: bodies run in a thread that the caller stops waiting for.

Python cannot stop a thread, so what is left behind is told in two ways: its Spark jobs carry a
tag and are cancelled by it, and code that wants to end early asks the token.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread, SparkContext

from weirflow.flow.errors import AttemptTimeout, Cancelled


class Cancel:
    """Shared by a handle and the stages it may stop; cancelling twice is cancelling once."""

    def __init__(self) -> None:
        self._event, self._lock, self._told = threading.Event(), threading.Lock(), []

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self) -> None:
        with self._lock:
            if self._event.is_set():
                return
            self._event.set()
            told = list(self._told)
        for f in told:
            f()

    def check(self) -> None:
        if self._event.is_set():
            raise Cancelled("the run was cancelled")

    def sleep(self, seconds: float) -> None:
        if self._event.wait(seconds):
            self.check()

    def on_cancel(self, f: Callable[[], None]) -> Callable[[], None]:
        """Calls ``f`` once when cancelled, at once if it is; gives what takes that back."""
        with self._lock:
            if not self._event.is_set():
                self._told.append(f)
                return lambda: self._told.remove(f) if f in self._told else None
        f()
        return lambda: None

    def child(self) -> Cancel:
        """A token that this one cancels, and that can be cancelled by itself."""
        out = Cancel()
        self.on_cancel(out.cancel)
        return out


class Tagged:
    """Spark jobs started inside carry a tag by which they can be cancelled."""

    def __init__(self) -> None:
        self.tag = f"weirflow-{uuid.uuid4().hex}"

    def __enter__(self) -> Tagged:
        self._sc = SparkContext._active_spark_context
        if self._sc:
            self._sc.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        if self._sc and SparkContext._active_spark_context is self._sc:
            self._sc.removeJobTag(self.tag)

    def cancel_jobs(self) -> None:
        sc = SparkContext._active_spark_context
        if sc:
            sc.cancelJobsWithTag(self.tag)


def race(f: Callable[[], object], seconds: float | None = None, cancel: Cancel | None = None, late: Callable[[], Exception] | None = None):
    """The result of ``f``, unless the token is cancelled or the time is up before; of both at once, cancelling counts."""
    if cancel:
        cancel.check()
    if seconds is None and cancel is None:
        return f()
    wake, tagged, box = threading.Event(), Tagged(), {}

    def body() -> None:
        try:
            with tagged:
                box["value"] = f()
        except BaseException as e:  # noqa: BLE001  handed to the caller
            box["error"] = e
        finally:
            wake.set()

    thread = (InheritableThread if SparkContext._active_spark_context else threading.Thread)(target=body, daemon=True)
    forget = cancel.on_cancel(wake.set) if cancel else lambda: None
    try:
        thread.start()
        wake.wait(seconds if seconds is None else max(0.0, seconds))
    finally:
        forget()
    if cancel and cancel.cancelled:
        tagged.cancel_jobs()
        cancel.check()
    if "error" in box:
        raise box["error"]
    if "value" not in box:
        tagged.cancel_jobs()
        raise late() if late else AttemptTimeout(f"the attempt took more than {seconds} s")
    return box["value"]


def remaining(ends: float | None) -> float | None:
    """Seconds until a monotonic instant."""
    return None if ends is None else max(0.0, ends - time.monotonic())
