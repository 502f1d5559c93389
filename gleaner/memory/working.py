"""Small mutable pointers of a session; bodies of data stay in recordsets."""

from __future__ import annotations

from typing import Any


class WorkingMemory:
    def __init__(self, store: dict[str, Any] | None = None):
        self._store = {} if store is None else store

    @property
    def data(self) -> dict[str, Any]:
        return self._store

    def get(self, slot: str) -> dict[str, Any] | None:
        found = self._store.get(slot)
        return found if isinstance(found, dict) else None

    def set(self, slot: str, pointer: dict[str, Any]) -> None:
        if not isinstance(pointer, dict):
            raise TypeError("a pointer is a dict")
        self._store[slot] = dict(pointer)

    def clear(self, slot: str) -> None:
        self._store.pop(slot, None)

    def has(self, slot: str) -> bool:
        return slot in self._store
