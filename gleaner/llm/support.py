"""Shared plumbing of the training-data operators: durable intermediate tables, bitmap filters, components.

Intermediate tables are Parquet files in the folder that the cluster names in ``spark.checkpoint.dir``;
every executor can read them, so a lost executor costs a re-read and never a recomputation from scratch.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import words

class _Written(threading.local):
    """The intermediate tables that a thread has written, so that one run's cleanup never takes another's."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        _everyones.append(self.tables)


_everyones: list[list[tuple[SparkSession, str]]] = []
_own = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    ``spark.checkpoint.dir`` when the session has it, else the context's checkpoint folder.  Only a local
    master may fall back to a temporary folder, because on a cluster no other machine would see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="gleaner-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _own.tables.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._gleaner_path = path
    return table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a key of each row, and the key's name: ids may be null or repeat."""
    row = unused(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mark() -> int:
    """How many intermediate tables this thread has now, for ``release``."""
    return len(_own.tables)


def release(since: int = 0, last: int = 0) -> None:
    """Delete the intermediate tables that this thread wrote after ``since`` but for the ``last`` ones; lazy results that read them end with it."""
    tables = _own.tables
    gone = tables[since : len(tables) - last]
    del tables[since : len(tables) - last]
    for spark, path in gone:
        _delete(spark, path)


@atexit.register
def _release_all() -> None:
    for tables in _everyones:
        while tables:
            _delete(*tables.pop())


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = table._gleaner_path
        for tables in _everyones:
            tables[:] = [w for w in tables if w[1] != path]
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is the cluster's to purge
        pass


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; a worker that waits for its next task gives back what the last one held."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            words.free()

    return freed


# -- bitmaps -------------------------------------------------------------------------------------------


class Flags:
    """A set of hashes as ``2**bits`` flags: a filter without false negatives."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.size = packed, 8 * len(packed)

    def has(self, slot: np.ndarray) -> np.ndarray:
        """Whether each hash of ``slot`` is flagged; only its low bits count."""
        at = slot.astype(np.int64) & (self.size - 1)
        return ((self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.bool_)

    @property
    def share(self) -> float:
        return float(np.unpackbits(self.packed).mean())


def bitmap(keys: DataFrame, key: Column, most: int = 26) -> Flags:
    """The flags of the ``key`` hashes of ``keys``, eight for each of them, but never more than ``2**most``.

    So a broadcast map has 8 MB at most, however many keys there are; a full map lets everything pass and only
    costs speed.  Executors OR the flags together; the driver gets at most ``2**most / 64`` words.
    """
    bits = min(most, max(16, (8 * keys.count()).bit_length()))
    slot = F.pmod(key, F.lit(1 << bits))
    words = (
        keys.select(slot.alias("s"))
        .select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("m"))
        .groupBy("w")
        .agg(F.expr("bit_or(m)").alias("m"))
        .toArrow()
    )
    flags = np.zeros(1 << (bits - 6), np.int64)
    flags[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return Flags(flags.view(np.uint8))


def pass_bitmap(df: DataFrame, key: Column, flags: Flags) -> DataFrame:
    """Rows of ``df`` whose ``key`` hash is flagged, before a shuffle of wide rows."""
    if flags.share > 0.5:
        return df
    shared = df.sparkSession.sparkContext.broadcast(flags.packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Flags(shared.value)
        for batch in batches:
            kept = batch.filter(pa.array(local.has(batch.column(0).to_numpy(zero_copy_only=False))))
            if kept.num_rows:
                yield kept.select(list(range(1, kept.num_columns)))

    slotted = df.select(F.pmod(key, F.lit(flags.size)).alias("__slot"), *[F.col(f"`{c}`") for c in df.columns])
    return slotted.mapInArrow(lean(run), df.schema)


def rows_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the written table ``base`` whose key ``row`` is in ``wanted``, joined with it; others are not shuffled."""
    key = F.xxhash64("row")
    return pass_bitmap(base, key, bitmap(wanted, key)).join(wanted, "row")


# -- union-find grouping -------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: every node once, with its smallest node so far."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    links = [(x, r) for x in parent if (r := find(x)) != x]
    for i in range(0, len(links), 100_000):
        u, v = zip(*links[i : i + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; root is the smallest node that it reaches.

    Tasks first contract their own links by union-find to a forest; then large-star and small-star rounds
    meet across tasks, with one written table a round, until the links no longer change.
    """
    edges = materialize(links.select("u", "v").mapInArrow(lean(_forest), "u long, v long"), "forest")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.where("u <> v").distinct(), "stars")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own).distinct()
