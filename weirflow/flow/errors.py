"""Errors with a stable category."""

from __future__ import annotations


class FlowError(Exception):
    """``category`` is that of the innermost error, ``outer_category`` of this one."""

    category = "task_execution"

    @property
    def outer_category(self) -> str:
        return self.category

    @property
    def inner(self) -> Exception:
        return self


class ConfigurationError(FlowError):
    category = "configuration"


class RetryExhausted(FlowError):
    category = "retry_exhausted"

    def __init__(self, attempts: int, source: Exception) -> None:
        super().__init__(f"{attempts} attempts: {source}")
        self.attempts, self.source = attempts, source


class CircuitOpen(FlowError):
    category = "circuit_open"


class Cancelled(FlowError):
    category = "cancelled"


class AttemptTimeout(FlowError):
    category = "timeout"


class WorkflowTimeout(FlowError):
    category = "workflow_timeout"


class RateLimited(FlowError):
    """Which tier refused, and after how many seconds it might not."""

    category = "rate_limited"

    def __init__(self, tier: str, retry_after: float) -> None:
        super().__init__(f"{tier} admits again in {retry_after:.3f} s")
        self.tier, self.retry_after = tier, retry_after


class CheckpointConflict(FlowError):
    category = "checkpoint_store"


class OrphanedCompensation(FlowError):
    """A completed step that nothing can undo any more, with its output."""

    category = "orphaned_compensation"

    def __init__(self, task_id: str, blob: str | None) -> None:
        super().__init__(f"nothing undoes {task_id}")
        self.task_id, self.blob = task_id, blob


def attempts_of(error: Exception) -> int:
    """How often a failed stage was tried: not at all behind an open circuit, past the deadline or when cancelled."""
    if isinstance(error, RetryExhausted):
        return error.attempts
    return 0 if isinstance(error, (CircuitOpen, WorkflowTimeout, Cancelled)) else 1


class StateError(FlowError):
    """Where a run failed: the state, the path to it, the attempts and the error, which is never wrapped twice."""

    def __init__(self, state: str, path: list[str], source: Exception) -> None:
        super().__init__(f"in {state} after {path}: {source}")
        self.state, self.path, self.source, self.attempt = state, path, source, attempts_of(source)

    @property
    def category(self) -> str:
        return getattr(self.source, "category", FlowError.category)

    @property
    def outer_category(self) -> str:
        return "state"

    @property
    def inner(self) -> Exception:
        return self.source

    @classmethod
    def around(cls, state: str, path: list[str], source: Exception) -> StateError:
        """Cancelled runs and runs past their deadline can be caught as such."""
        if isinstance(source, StateError):
            return source
        kind = CancelledRun if isinstance(source, Cancelled) else TimedOutRun if isinstance(source, WorkflowTimeout) else cls
        return kind(state, path, source)


class CancelledRun(StateError, Cancelled):
    category = Cancelled.category


class TimedOutRun(StateError, WorkflowTimeout):
    category = WorkflowTimeout.category


class CompensationFailed(FlowError):
    """The error that began the rollback, and those of the steps that could not be undone."""

    category = "compensation_failed"

    def __init__(self, errors: list[Exception]) -> None:
        super().__init__("; ".join(map(str, errors)))
        self.errors = errors
