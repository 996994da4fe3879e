"""A keyed store and resources with a life cycle."""

from __future__ import annotations

from dataclasses import dataclass, field

from weirflow.flow.errors import ConfigurationError, FlowError

HEALTH = ("healthy", "degraded", "unhealthy")


class Store(dict):
    """Last write wins; a wanted key must exist; append extends a list or starts one."""

    def need(self, key: str):
        if key not in self:
            raise FlowError(f"no key {key!r}")
        return self[key]

    def append(self, key: str, value) -> None:
        held = self.setdefault(key, [])
        if not isinstance(held, list):
            raise FlowError(f"{key!r} holds no list")
        held.append(value)


@dataclass
class Resources:
    """Set up in order of arrival, torn down in reverse; a failed set-up tears down what was up."""

    held: dict = field(default_factory=dict)

    def insert(self, name: str, resource) -> None:
        if name in self.held:
            raise ConfigurationError(f"resource {name!r} exists")
        self.held[name] = resource

    def __enter__(self) -> Resources:
        up = []
        for name, r in self.held.items():
            try:
                getattr(r, "setup", lambda: None)()
            except Exception:
                for n in reversed(up):
                    getattr(self.held[n], "teardown", lambda: None)()
                raise
            up.append(name)
        return self

    def __exit__(self, *_) -> None:
        for r in reversed(list(self.held.values())):
            try:
                getattr(r, "teardown", lambda: None)()
            except Exception:  # noqa: BLE001, S110  the others still go down
                pass

    def get(self, name: str, kind: type | None = None):
        """A resource by name, of the kind wanted."""
        if name not in self.held:
            raise ConfigurationError(f"no resource {name!r}")
        found = self.held[name]
        if kind is not None and not isinstance(found, kind):
            raise ConfigurationError(f"resource {name!r} is no {kind.__name__}")
        return found

    def check(self) -> dict[str, str]:
        """The health of each resource; one that cannot tell is unhealthy."""
        out = {}
        for name, r in self.held.items():
            try:
                out[name] = getattr(r, "health", lambda: "healthy")()
            except Exception:  # noqa: BLE001
                out[name] = "unhealthy"
        return out

    def health(self) -> str:
        """The worst; of equals the first."""
        return max(self.check().values(), key=HEALTH.index, default="healthy")

    def worst(self) -> tuple[str, str] | None:
        """The resource that decides the health, and its health."""
        return max(self.check().items(), key=lambda x: HEALTH.index(x[1]), default=None)
