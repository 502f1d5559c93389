"""Reranking: a second score per (question, text), then a walk with a cap per source.

The walk "take the next best unless its source is used up, until enough are kept" needs no loop: a rank within
the source tells who is over the cap, and a running count of the others tells who is kept and how many were
passed over before the walk ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx

MAX_CHARS = 4000
KEEP = 5


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has: the default scorer, without a model."""
    asked = F.array_distinct(tx.tokens(question))
    found = F.array_intersect(asked, tx.tokens(text))
    return F.coalesce(F.size(found) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)).cast("double")


def model_score(fn: Callable[[str, list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A Column scorer from ``(question, texts) -> scores``, run on Arrow batches in the workers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for question, text in batches:
            out = pd.Series(0.0, index=text.index)
            for asked, rows in text.groupby(question):
                scores = list(fn(asked, rows.tolist()))
                if len(scores) != len(rows):
                    raise ValueError(f"the reranker gave {len(scores)} scores for {len(rows)} texts")
                out.loc[rows.index] = [float(s) for s in scores]
            yield out

    return run


def rerank(
    candidates: DataFrame, *, scorer: Callable[[Column, Column], Column] = lexical_score, keep: int = KEEP, max_per_source: int | None = None,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """From ``(qid, question, retrieval_rank, id, source_id, text)``: the kept rows with ``rerank_score, rank, rank_change, skipped_over_source_limit``."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.substring("text", 1, max_chars)))
    order = [F.desc(F.round("rerank_score", 9)), "retrieval_rank"]
    source = F.coalesce(F.col("source_id").cast("string"), F.col("id").cast("string")) if "source_id" in candidates.columns else F.col("id")
    within = F.row_number().over(Window.partitionBy("qid", "__source").orderBy(*order))
    scored = scored.withColumn("__source", source)
    scored = scored.withColumn("__ok", F.lit(True) if max_per_source is None else within <= max_per_source)
    run = Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = scored.withColumn("__r", F.sum(F.col("__ok").cast("int")).over(run))
    passed = F.sum((~F.col("__ok") & (F.col("__r") < keep)).cast("int")).over(Window.partitionBy("qid"))
    scored = scored.withColumn("skipped_over_source_limit", passed)
    out = scored.where(F.col("__ok") & (F.col("__r") <= keep))
    return out.select(
        *[F.col(f"`{c}`") for c in candidates.columns if c != "text"],
        F.col("__r").cast("int").alias("rank"), F.round("rerank_score", 6).alias("rerank_score"),
        (F.col("retrieval_rank") - F.col("__r")).cast("int").alias("rank_change"), tx.snippet(F.col("text")).alias("snippet"), "skipped_over_source_limit",
    )
