"""The query catalogue of the engine's own operators."""

from __future__ import annotations

from gleaner.plans import evidence, files, graphs, hosts, retrieval, tasks
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evidence", "files", "graphs", "hosts", "retrieval", "tasks"]
