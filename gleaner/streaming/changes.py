"""A BM25 index kept up to date by a stream of changes: a log-structured merge of runs of postings.

A batch of changes (new texts, texts that replace others, deletions) becomes a run of its own: the newest change of
every document in it, and the postings of its texts.  What a later run says of a document counts; a deletion is a row
without text.  Whenever ``FAN`` runs of one size are complete they are merged into one run of the next size, so after n
batches a reader meets at most FAN - 1 runs of each of log n sizes, and each posting is rewritten log n times.  A merged
run that begins with the first batch has nothing below it and drops its deletions.

Which runs make up the state follows from the number of batches alone; a merge that was not finished is replaced by its
parts.  Every run is a folder named by its batches and written anew when a batch is repeated, so a restart changes
nothing.  ``vacuum`` deletes runs that a complete merge covers, once no reader uses them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.postings import counted
from gleaner.operators.ranking import Index
from gleaner.session import checkpointed
from gleaner.sources.corpus import POSITION

FAN = 4
DOCS, TF = f"{POSITION} long, batch long, len int, gone boolean", f"{POSITION} long, batch long, len int, term string, tf int"


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _complete(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """First and last batch of every run whose tables are both committed; the documents are written last."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("run_") and fs.exists(_folder(spark, f"{path}/{n}/docs/_SUCCESS")[1])]
    return {(int(a), int(b)) for _, a, b in (n.split("_") for n in done)}


def _cover(lo: int, size: int, there: set[tuple[int, int]], fan: int) -> list[tuple[int, int]]:
    """The run of ``size`` batches from ``lo``, or the runs that it would be made of."""
    if size == 1 or (lo, lo + size - 1) in there:
        return [(lo, lo + size - 1)]
    return [run for part in range(fan) for run in _cover(lo + part * (size // fan), size // fan, there, fan)]


def runs_of(batches: int, there: set[tuple[int, int]], fan: int = FAN) -> list[tuple[int, int]]:
    """The runs that hold batches 0 to ``batches - 1``: as few as the finished merges allow."""
    out: list[tuple[int, int]] = []
    size = 1
    while size * fan <= batches:
        size *= fan
    while (lo := out[-1][1] + 1 if out else 0) < batches:
        while size > batches - lo:
            size //= fan
        out += _cover(lo, size, there, fan)
    return out


def _read(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """The newest row of every document, deletions included, and the postings of exactly these rows."""
    read = lambda part, schema: reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/run_{a}_{b}/{part}") for a, b in runs])
    newest = read("docs", DOCS).groupBy(POSITION).agg(F.max_by(F.struct("batch", "len", "gone"), "batch").alias("d")).select(POSITION, "d.*")
    live = newest.where("not gone").select(POSITION, "batch")
    return newest, read("tf", TF).join(live, [POSITION, "batch"], "left_semi")


def _write(docs: DataFrame, tf: DataFrame, path: str, lo: int, hi: int) -> None:
    tf.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/run_{lo}_{hi}/tf")
    docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/run_{lo}_{hi}/docs")


def apply_batch(changes: DataFrame, number: int, path: str, *, fan: int = FAN) -> None:
    """Add the changes ``(_pos, text, gone, at)`` of one batch as a run, and merge the runs that it completes."""
    spark = changes.sparkSession
    last = changes.groupBy(POSITION).agg(F.max_by(F.struct("text", F.coalesce("gone", F.lit(False)).alias("gone")), "at").alias("c"))
    last = checkpointed(last.select(POSITION, F.when(~F.col("c.gone"), F.coalesce("c.text", F.lit(""))).alias("text"), "c.gone"))
    told = checkpointed(counted(last.where("not gone")))
    batch = F.lit(number).cast("long").alias("batch")
    texts = told.where("term is null").select(POSITION, batch, "len", F.lit(False).alias("gone"))
    gone = last.where("gone").select(POSITION, batch, F.lit(0).alias("len"), "gone")
    _write(texts.unionByName(gone), told.where("term is not null").select(POSITION, batch, "len", "term", "tf"), path, number, number)
    size = fan
    while (number + 1) % size == 0:
        lo = number + 1 - size
        docs, tf = _read(spark, path, _cover(lo, size, _complete(spark, path) - {(lo, number)}, fan))
        _write(docs.where("not gone") if lo == 0 else docs, tf, path, lo, number)
        size *= fan


def maintain(changes: DataFrame, path: str, checkpoint: str, *, fan: int = FAN, **trigger: object) -> StreamingQuery:
    """Start a stream that keeps the index under ``path``; within a batch the change of a document with the largest ``at`` counts."""
    start = changes.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, path, fan=fan))
    return start.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index(spark: SparkSession, path: str, *, fan: int = FAN) -> Index:
    """The index after the last batch whose run is complete."""
    there = _complete(spark, path)
    batches = max((b + 1 for _, b in there), default=0)
    if not batches:
        raise FileNotFoundError(f"no index under {path}")
    docs, tf = _read(spark, path, runs_of(batches, there, fan))
    live = docs.where("not gone")
    stats = live.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    tf = tf.select(POSITION, "len", "term", "tf")
    return Index(tf, tf.groupBy("term").agg(F.count("*").alias("df")), stats)


def vacuum(spark: SparkSession, path: str, *, fan: int = FAN) -> int:
    """Delete the runs that the state does not need; returns how many."""
    there = _complete(spark, path)
    needed = set(runs_of(max((b + 1 for _, b in there), default=0), there, fan))
    for a, b in there - needed:
        fs, where = _folder(spark, f"{path}/run_{a}_{b}")
        fs.delete(where, True)
    return len(there - needed)
