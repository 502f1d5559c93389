"""Incremental BM25 statistics: each micro-batch of documents adds its postings to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.ranking import Index, build_index
from gleaner.sources.corpus import POSITION


def maintain(texts: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a stream that appends the postings of ``texts(_pos, text)`` under ``path``.

    Every batch writes a folder of its own and overwrites it when it is repeated, so a restart adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        made = build_index(batch)
        made.tf.write.mode("overwrite").parquet(f"{path}/tf/batch={number}")
        sized = batch.select(F.count("*").alias("n")).crossJoin(made.stats.select("avg_len"))  # one row each
        sized.write.mode("overwrite").parquet(f"{path}/stats/batch={number}")

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index(spark: SparkSession, path: str) -> Index:
    """The index over all batches so far."""
    tf = spark.read.parquet(f"{path}/tf").drop("batch")
    stats = spark.read.parquet(f"{path}/stats").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("avg_len")) / F.sum("n")).alias("avg_len"))
    return Index(tf.select(POSITION, "len", "term", "tf"), tf.groupBy("term").agg(F.count("*").alias("df")), stats)
