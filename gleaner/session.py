"""Session settings that the engine relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_stored: list[tuple[SparkSession, str]] = []
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and send them texts in small batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    if spark.conf.get(BATCH) == "10000":  # Spark's default suits narrow rows; whole texts take kilobytes each
        spark.conf.set(BATCH, "1000")
    if spark.conf.get(BATCH_BYTES, None) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(BATCH_BYTES, "8MB")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only on a local master."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a table in the shared checkpoint folder, which survives lost executors.

    Written once, as columns of known size, so a reader prunes it and the planner sees how small it is.  Types that
    Parquet has no form for go through Spark's own checkpoint.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        return df.checkpoint()
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    _stored.append((spark, path))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_stored() -> None:
    """Delete the tables of ``checkpointed``; lazy results that read them end with it."""
    while _stored:
        spark, path = _stored.pop()
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder is the cluster's to purge
            pass


def spread(df: DataFrame, *, per_core: int = 64 << 20) -> DataFrame:
    """``df`` dealt to all cores when it is small enough that its files may make fewer tasks than there are cores.

    Larger tables have a task for each split already and are left alone, so no large text is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core else df


def local(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests, benchmarks and notebooks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gleaner")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
