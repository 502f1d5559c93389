"""The commit log: parallel writers, replays, tables of recordsets."""

from __future__ import annotations

import subprocess
import sys
import threading
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.memory.commits import CommitLogStore
from gleaner.memory.facade import Memory
from gleaner.memory.records import value_ref

ROOT = Path(__file__).resolve().parent.parent


def test_parallel_writers_never_share_a_handle(spark, tmp_path):
    stores = [CommitLogStore(spark, f"file://{tmp_path}/m") for _ in range(6)]
    given, failed = [], []

    def write(store):
        try:
            for _ in range(15):
                given.append(Memory(store, session_id="s").remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([1])).handle)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(given, key=lambda h: int(h[5:])) == [f"rows_{i + 1}" for i in range(90)]
    assert len(Memory(CommitLogStore(spark, f"file://{tmp_path}/m"), session_id="s").list()) == 90


def test_parallel_processes_never_share_a_number(tmp_path):
    """The create-if-absent step itself, in processes of their own."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from gleaner.memory.commits import _Files
files = object.__new__(_Files); files.local = {str(tmp_path)!r}
n = 0
for _ in range(200):
    while not files.create(f"{{n:020d}}.json", sys.argv[1] + "\\n"):
        n += 1
"""
    runs = [subprocess.Popen([sys.executable, "-c", code, str(i)]) for i in range(4)]
    assert [r.wait(120) for r in runs] == [0] * 4
    names = sorted(p.name for p in tmp_path.glob("*.json"))
    assert names == [f"{i:020d}.json" for i in range(800)] and Counter(p.read_text() for p in tmp_path.glob("*.json")) == {f"{i}\n": 200 for i in range(4)}


def test_a_later_process_reads_what_was_kept(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    first = Memory(CommitLogStore(spark, path), session_id="a b/ü")
    one = first.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([1, 2]))
    two = first.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([3]), derived_from=[one.handle])
    other = Memory(CommitLogStore(spark, path), session_id="a b/ü")
    assert other.get(two.handle).derived_from == [one.handle] and other.records(other.bind(object_type="rows", tool_name="t")) == [3]
    other.purge(two.handle)
    assert first.get(two.handle) is None and first.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([])).handle == "rows_3"
    told = {r.handle: (r.owner, r.n) for r in CommitLogStore(spark, path).table().collect()}
    assert told == {"rows_1": ("session:a b/ü", 2)}  # an empty recordset has a name and is not kept


def test_rows_of_any_size_stay_in_spark(spark, tmp_path):
    store = CommitLogStore(spark, f"file://{tmp_path}/m")
    memory = Memory(store, session_id="s")
    ref, n = store.put_rows(spark.range(5000).withColumn("x", F.col("id") * 2))
    made = memory.remember(object_type="table", stage="gather", produced_by="p", ref=ref, count=n)
    again = CommitLogStore(spark, f"file://{tmp_path}/m")
    assert again.rows(Memory(again, session_id="s").get(made.handle)).agg(F.sum("x")).first()[0] == 5000 * 4999
    with pytest.raises(ValueError):
        again.rows(memory.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([1])))
