"""A narrated log of what memory did: never payloads, and never an error of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, Protocol

QUIET, NORMAL, VERBOSE = 0, 1, 2
#: Operations that only a verbose log has.
_DETAIL = {"read", "digest"}


class Sink(Protocol):
    def emit(self, entry: dict[str, Any]) -> None: ...


class NullSink:
    def emit(self, entry: dict[str, Any]) -> None:
        pass


class ListSink:
    def __init__(self) -> None:
        self.entries: list[dict[str, Any]] = []

    def emit(self, entry: dict[str, Any]) -> None:
        self.entries.append(entry)

    def ops(self) -> list[str]:
        return [e["op"] for e in self.entries]

    def explanations(self) -> list[str]:
        return [e["explanation"] for e in self.entries]


class Timer:
    def __init__(self) -> None:
        self._start = time.perf_counter()

    @property
    def ms(self) -> float:
        return round((time.perf_counter() - self._start) * 1000, 3)


class OpLog:
    def __init__(self, sink: Sink | None = None, *, level: int = NORMAL):
        self.sink, self.level = sink or NullSink(), level

    def say(self, op: str, explanation: str | Callable[[], str], **details: Any) -> None:
        if self.level == QUIET or (op in _DETAIL and self.level < VERBOSE):
            return
        try:
            self.sink.emit({"op": op, "explanation": explanation() if callable(explanation) else explanation} | {k: v for k, v in details.items() if v is not None})
        except Exception:  # noqa: BLE001  a broken sink must not break the tool
            pass
