"""Callbacks on the life of a knowledge base."""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

log = logging.getLogger("tomelattice")

TYPES = (
    "DOCUMENT_RECEIVED", "DOCUMENT_SKIPPED", "DOCUMENT_CHUNKED", "COMPREHEND_STARTED", "COMPREHEND_FINISHED", "TREE_BUILT", "TREE_UPDATED",
    "NAVIGATION_STARTED", "NAVIGATION_STEP", "NAVIGATION_FINISHED", "CONTENT_READ", "COMMITTED", "FAILED",
)


@dataclass
class Event:
    type: str
    data: dict = field(default_factory=dict)
    error: Exception | None = None
    millis: int = 0
    at: float = field(default_factory=time.time)


class Hooks:
    """Callbacks by type, called in ascending order, equals as registered; a failing one is logged and the rest go on."""

    def __init__(self) -> None:
        self._of: dict[str, list[tuple[int, int, Callable[[Event], None]]]] = {}

    def register(self, type: str, hook: Callable[[Event], None] | str, order: int = 0) -> None:
        """hook: a callable, or 'module:name' of a class or function."""
        if type not in TYPES:
            raise ValueError(f"unknown event {type}")
        if isinstance(hook, str):
            module, _, name = hook.partition(":")
            hook = getattr(importlib.import_module(module), name)
            hook = hook() if isinstance(hook, builtin_type) else hook
        entries = self._of.setdefault(type, [])
        entries.append((order, len(entries), hook))

    def fire(self, type: str, error: Exception | None = None, millis: int = 0, **data) -> None:
        for _, _, hook in sorted(self._of.get(type, ()), key=lambda x: x[:2]):
            try:
                hook(Event(type, data, error, millis))
            except Exception:
                log.exception("a hook on %s failed", type)


builtin_type = type


def logging_hook(event: Event) -> None:
    """Logs every event, failures as warnings."""
    log.log(logging.WARNING if event.error else logging.INFO, "%s %s %d ms%s", event.type, event.data, event.millis, f" {event.error}" if event.error else "")
