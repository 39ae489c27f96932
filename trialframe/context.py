"""What a block may use besides its input."""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from logging import Logger, getLogger

from trialframe.errors import Cancelled, ConfigError, Paused


class Token:
    """Cooperative pause and cancellation; ``check`` raises once either was asked for."""

    def __init__(self) -> None:
        self._pause, self._cancel = threading.Event(), threading.Event()

    def pause(self) -> None:
        self._pause.set()

    def cancel(self) -> None:
        self._cancel.set()

    def check(self) -> None:
        if self._cancel.is_set():
            raise Cancelled
        if self._pause.is_set():
            raise Paused

    def on_signals(self) -> Callable[[], None]:
        """The first SIGINT or SIGTERM pauses, the second cancels. Returns what puts the old handlers back."""
        import signal

        def handle(*_: object) -> None:
            (self.cancel if self._pause.is_set() else self.pause)()

        old = {s: signal.signal(s, handle) for s in (signal.SIGINT, signal.SIGTERM)}
        return lambda: [signal.signal(s, h) for s, h in old.items()]


class EnvironmentSecrets:
    def get(self, name: str) -> str:
        """The value of ``secret://name``, from the environment."""
        key = name.removeprefix("secret://")
        if key not in os.environ:
            raise ConfigError(f"secret {key!r} is not set")
        return os.environ[key]


@dataclass
class Context:
    """Seeds, parameters, services; picklable but for the store and the token."""

    run_id: str = "run"
    seed: int = 0
    parameters: dict = field(default_factory=dict)
    work_dir: str | None = None
    store: object | None = None
    artifacts: object | None = None
    #: The resource profile of the node's tasks, for ``mapInArrow`` and ``mapInPandas``; set by the pipeline.
    profile: object | None = None
    token: Token = field(default_factory=Token)
    secrets: EnvironmentSecrets = field(default_factory=EnvironmentSecrets)
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)

    @property
    def logger(self) -> Logger:
        return getLogger(f"trialframe.{self.run_id}")

    def stream(self, name: str) -> int:
        """A 32-bit seed of a named stream, from a hash of the whole name."""
        return int.from_bytes(hashlib.sha256(f"{self.seed}:{name}".encode()).digest()[:4], "big")

    def report_metric(self, name: str, value: object, partition_id: str | None = None) -> None:
        if self.store is not None:
            self.store.report_metric(self.run_id, name, value, partition_id)

    def save_checkpoint(self, payload: object, fingerprint: str = "") -> int | None:
        """Keep a block's progress; its number, or None without a store."""
        return None if self.store is None else self.store.save_checkpoint(self.run_id, payload, fingerprint)

    def latest_checkpoint(self, fingerprint: str | None = None) -> object | None:
        return None if self.store is None else self.store.latest_checkpoint(self.run_id, fingerprint)
