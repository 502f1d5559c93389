"""The catalogue of recordsets: one owner's part of a store, and recordset metadata as tables."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import checkpointed
from gleaner.memory.records import Recordset
from gleaner.memory.stores import Store


class Catalog:
    """What one session or project has stored.  Rows are read from the store at every call; nothing is kept here."""

    def __init__(self, store: Store, owner: str):
        self.store, self.owner = store, owner

    def name(self, object_type: str) -> str:
        """A handle that was never given before."""
        return self.store.allocate_handle(owner=self.owner, object_type=object_type)

    def row(self, handle: str) -> Recordset | None:
        return self.store.read(handle, owner=self.owner)

    def rows(self, object_type: str | None = None, *, evicted: bool = False, limit: int | None = None) -> list[Recordset]:
        """Newest first; ``evicted`` shows those of which only metadata is left, too."""
        return self.store.query(owner=self.owner, object_type=object_type, limit=limit, include_tombstoned=evicted)

    def children(self) -> dict[str, list[str]]:
        """Every handle that others were derived from, with those others."""
        found: dict[str, list[str]] = defaultdict(list)
        for row in self.rows(evicted=True):
            for parent in dict.fromkeys(row.derived_from):
                found[parent].append(row.handle)
        return found

    def descendants(self, handle: str, *, levels: int | None = None) -> list[str]:
        """A handle and what derives from it, level by level, each once."""
        children, reached, level = self.children(), [handle], [handle]
        while level and levels != 0:
            level = list(dict.fromkeys(c for h in level for c in children.get(h, []) if c not in reached))
            reached += level
            levels = None if levels is None else levels - 1
        return reached

    def evict(self, handle: str, *, keep_metadata: bool = False) -> bool:
        return self.store.delete(handle, owner=self.owner, tombstone=keep_metadata)


def lineage_table(records: DataFrame) -> DataFrame:
    """``(handle, ancestor, distance)`` of records ``(handle, parent)``, however many: each round doubles the distance.

    A path cannot be longer than there are records; a longer one comes from a cycle, which is an error.
    """
    found = checkpointed(records.where("parent is not null").select("handle", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach, most = 1, records.count()
    while True:
        ahead = found.select(F.col("handle").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        far = found.where(F.col("distance") == reach).join(ahead, "ancestor")
        new = checkpointed(far.select("handle", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")))
        if new.isEmpty():
            return found
        reach *= 2
        if reach > most:
            raise ValueError("the records derive from each other in a cycle")
        found = checkpointed(found.unionByName(new))
