"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, in this order.

Every stage works on all documents that its predecessor kept.  The first four return the columns of their
input; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import prepare
from gleaner.llm import decontaminate, line_dedup, near_dedup, packing, quality, support


def _keep(keyed: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is in the first column of ``kept``, without the key."""
    key = support.unused(keyed, "__kept_key")
    return keyed.join(kept.select(F.col(kept.columns[0]).alias(key)), F.col(row) == F.col(key), "left_semi").drop(row)


def _with_text(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` out of the struct ``doc``, with a new text where there is one; ``n_chars`` follows it."""
    there = F.col(text).isNotNull()
    new = {"text": F.coalesce(text, "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(there, F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without their host's boilerplate lines; ``n_chars`` follows the text."""
    prepare(spark)
    return _with_text(docs, quality.quality(docs, columns=True).where("kept"), "kept_text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten documents share; ``n_chars`` follows the text."""
    prepare(spark)
    cut = line_dedup.drop_frequent_lines(docs, columns=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, nulls last, and of equal ids the first row."""
    prepare(spark)
    keyed, row = support.keyed(docs)
    found = near_dedup.near_duplicates(keyed, id_col=row).select(F.col("doc_id").alias("r"), "component_id")
    ids = keyed.select(F.col(row).alias("r"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "r")
    return _keep(keyed, row, found.join(ids, "r").groupBy("component_id").agg(F.min(order).alias("least")).select("least.r"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    prepare(spark)
    keyed, row = support.keyed(docs)
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return _keep(keyed, row, found.where("not contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left."""
    prepare(spark)
    return packing.pack_hierarchically(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Similarity components and packing are not SQL; tests compare the rows with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table is written and read again by the next, and what the stage wrote beside it goes."""
    prepare(spark)
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), support.mark()
    for name, stage in STAGES[:-1]:
        docs = support.materialize(stage(spark, docs, sf_dir), name)
        support.release(began, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
