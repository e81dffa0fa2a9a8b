"""What a step did: actions, metrics and warnings, kept on the driver."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("quern")


@dataclass
class StepReport:
    step: str
    actions: list[str] = field(default_factory=list)
    metrics: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def act(self, message: str) -> None:
        self.actions.append(message)

    def warn(self, message: str) -> None:
        self.warnings.append(message)

    def measure(self, key: str, value: Any) -> None:
        self.metrics[key] = value


@contextmanager
def timed(label: str, enabled: bool = True):
    """Logs the wall time of a block; put the action, not the lazy definition, inside."""
    began = time.perf_counter()
    try:
        yield
    finally:
        if enabled:
            log.info("%s: %.2f s", label, time.perf_counter() - began)


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""
