"""Where recordsets are kept.  Handles count up per owner and type and are never given twice."""

from __future__ import annotations

import json
import re
import threading
from pathlib import Path
from typing import Any

from gleaner.memory.records import PROJECT, Recordset, newest_first


def owner_key(*, scope: str, session_id: str, project: str) -> str:
    return f"project:{project}" if scope == PROJECT else f"session:{session_id}"


class Store:
    """Everything but the keeping itself: ``_load``, ``_save``, ``_drop``, ``_all`` and ``_last`` are the store's own."""

    def __init__(self) -> None:
        self._lock = threading.RLock()

    def allocate_handle(self, *, owner: str, object_type: str) -> str:
        with self._lock:
            return f"{object_type}_{self._last(owner, object_type)}"

    def write(self, record: Recordset) -> None:
        with self._lock:
            self._save(self.owner_of(record), record)

    def read(self, handle: str, *, owner: str) -> Recordset | None:
        with self._lock:
            return self._load(owner, handle)

    def query(self, *, owner: str, object_type: str | None = None, limit: int | None = None, include_tombstoned: bool = False) -> list[Recordset]:
        with self._lock:
            found = newest_first(r for r in self._all(owner) if object_type in (None, r.object_type) and (include_tombstoned or not r.tombstoned))
        return found if limit is None else found[:limit]

    def delete(self, handle: str, *, owner: str, tombstone: bool = False) -> bool:
        with self._lock:
            record = self._load(owner, handle)
            if record is None:
                return False
            if tombstone:
                self._save(owner, record.tombstone())
            else:
                self._drop(owner, handle)
            return True

    @staticmethod
    def owner_of(record: Recordset) -> str:
        return owner_key(scope=record.scope, session_id=record.session_id, project=record.project)


class InMemoryStore(Store):
    def __init__(self) -> None:
        super().__init__()
        self._kept: dict[tuple[str, str], Recordset] = {}
        self._numbers: dict[tuple[str, str], int] = {}

    def _last(self, owner: str, object_type: str) -> int:
        self._numbers[owner, object_type] = self._numbers.get((owner, object_type), 0) + 1
        return self._numbers[owner, object_type]

    def _load(self, owner: str, handle: str) -> Recordset | None:
        return self._kept.get((owner, handle))

    def _save(self, owner: str, record: Recordset) -> None:
        self._kept[owner, record.handle] = record

    def _drop(self, owner: str, handle: str) -> None:
        self._kept.pop((owner, handle), None)

    def _all(self, owner: str) -> list[Recordset]:
        return [r for (o, _), r in self._kept.items() if o == owner]


class JsonFileStore(Store):
    """One JSON file a recordset, and one a owner for the numbers given out."""

    def __init__(self, folder: str | Path):
        super().__init__()
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, owner: str, name: str) -> Path:
        safe = lambda s: re.sub(r"[^A-Za-z0-9._-]", lambda m: f"%{ord(m[0]):02x}", s)
        return self.folder / f"{safe(owner)}__{safe(name)}.json"

    def _put(self, path: Path, data: Any) -> None:
        part = path.with_suffix(".part")
        part.write_text(json.dumps(data, default=str))
        part.replace(path)

    def _last(self, owner: str, object_type: str) -> int:
        path = self._path(owner, ".allocated")
        numbers = json.loads(path.read_text()) if path.exists() else {}
        numbers[object_type] = numbers.get(object_type, 0) + 1
        self._put(path, numbers)
        return numbers[object_type]

    def _load(self, owner: str, handle: str) -> Recordset | None:
        path = self._path(owner, handle)
        return Recordset.from_dict(json.loads(path.read_text())) if path.exists() else None

    def _save(self, owner: str, record: Recordset) -> None:
        self._put(self._path(owner, record.handle), record.to_dict())

    def _drop(self, owner: str, handle: str) -> None:
        self._path(owner, handle).unlink(missing_ok=True)

    def _all(self, owner: str) -> list[Recordset]:
        files = self.folder.glob(self._path(owner, "*").name.replace("%2a", "*"))
        return [Recordset.from_dict(json.loads(f.read_text())) for f in files if not f.name.endswith("__.allocated.json")]


class NullStore(InMemoryStore):
    """Gives out handles and keeps nothing."""

    def _save(self, owner: str, record: Recordset) -> None:
        pass
