"""What is kept, what is shown of it, and what goes when."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from itertools import batched

from gleaner.memory.records import Recordset, newest_first

PAGE = 12


def human_bytes(size: int) -> str:
    for unit in ("B", "KB", "MB"):
        if size < 1024:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} GB"


def age_seconds(created_at: str, now: datetime | None = None) -> float | None:
    aware = lambda t: t if t.tzinfo else t.replace(tzinfo=UTC)
    try:
        return (aware(now or datetime.now(UTC)) - aware(datetime.fromisoformat(created_at))).total_seconds()
    except (TypeError, ValueError):
        return None


def age_phrase(created_at: str, now: datetime | None = None) -> str:
    s = age_seconds(created_at, now)
    if s is None:
        return "age unknown"
    if s < 45:
        return "just now"
    for limit, size, unit in ((3600, 60, "min"), (86400, 3600, "h")):
        if s < limit:
            return f"{max(1, int(s // size))} {unit} ago"
    return f"{int(s // 86400)} d ago"


@dataclass(frozen=True)
class DigestPage:
    text: str
    page: int = 1
    total_pages: int = 1
    shown: int = 0
    total: int = 0
    handles: list[str] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return not self.total


class DefaultPolicy:
    """Keeps what has records; shows pages of it; may evict by age and by number of a type."""

    def __init__(self, *, page_size: int = PAGE, max_age_seconds: float | None = None, max_per_object_type: int | None = None):
        self.page_size, self.max_age_seconds, self.max_per_object_type = page_size, max_age_seconds, max_per_object_type

    def admit(self, candidate: Recordset) -> bool:
        return candidate.count > 0

    def digest(self, available: Sequence[Recordset], *, page: int = 1) -> DigestPage:
        """One page of what is stored, newest first, as aligned columns; a page number outside is moved to the nearest."""
        pages = [p for p in batched((r for r in available if not r.tombstoned), self.page_size)]
        if not pages:
            return DigestPage("Nothing is stored in this session yet.")
        at, total = min(max(page, 1), len(pages)), sum(map(len, pages))
        shown = pages[at - 1]
        cells = [(r.handle, f"{r.count} {r.object_type}", "by reference" if r.is_reference else human_bytes(r.size_bytes), age_phrase(r.created_at), r.origin()) for r in shown]
        widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
        table = "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells)
        heading = f"{len(shown)} of {total} recordsets that a tool can take as input" + (f", page {at}/{len(pages)}" if len(pages) > 1 else "")
        return DigestPage(f"{heading}:\n{table}", at, len(pages), len(shown), total, [r.handle for r in shown])

    def evictable(self, available: Sequence[Recordset], *, now: datetime | None = None) -> list[tuple[Recordset, str]]:
        live, out = [r for r in available if not r.tombstoned], {}
        for r in live:
            age = age_seconds(r.created_at, now)
            if self.max_age_seconds is not None and age is not None and age > self.max_age_seconds:
                out[r.handle] = (r, f"{age:.0f} s old; the limit is {self.max_age_seconds:.0f} s")
        if self.max_per_object_type is not None:
            for kind in dict.fromkeys(r.object_type for r in live):
                for r in newest_first(x for x in live if x.object_type == kind)[self.max_per_object_type :]:
                    out.setdefault(r.handle, (r, f"more than {self.max_per_object_type} of {kind}"))
        return list(out.values())


class RetainAllPolicy(DefaultPolicy):
    """Keeps everything, empty recordsets too."""

    def admit(self, candidate: Recordset) -> bool:
        return True

    def evictable(self, available: Sequence[Recordset], *, now: datetime | None = None) -> list[tuple[Recordset, str]]:
        return []
