"""Where queries over the test tables register, each with its DuckDB SQL when SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.corpus import POSITION, Corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents as a corpus; the table has no date, so each gets a day of 2024 from its id."""
    df = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    df = df.withColumn(POSITION, F.col("doc_id")).withColumn("date", day.cast("string"))
    return Corpus(df.withColumn("doc_id", F.col("doc_id").cast("string")), "documents", "doc_id", "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
