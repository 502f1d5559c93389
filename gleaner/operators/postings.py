"""Postings in blocks with upper bounds, on storage: the best k of BM25 without reading every block.

A frequent term's postings lie in windows: documents of about one length (``STEPS`` classes an octave) among ``width``
consecutive positions.  A rare term's lie in blocks of ``ZONE`` positions.  Both are bounded, so a term that every
document has is many rows and never one group.  Length decides much of a score, so documents of one length have like
scores and a window of long ones is far below the best.  A block knows its ``peak``, the largest term factor of its postings.  Blocks are written clustered by term, so the terms of a
question are found by the files' statistics, and the wide column of postings is read for chosen blocks only.

A search adds, for each window, the weighted peaks of the question's frequent terms and the best sum of its rare ones
(all of which are read, as they are few): no document of the window can score more.  The windows with the largest
bounds are scored first; the k-th best score there is a floor for the result, and windows whose bound lies below it
are left out.  So a document is skipped only if it cannot be among the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import ranking
from gleaner.operators.ranking import counted
from gleaner.session import checkpointed
from gleaner.sources.corpus import POSITION

WIDTH, ZONE, STEPS = 512, 1 << 16, 4
#: Terms in at least this many documents have windows; question terms up to ``LISTED`` are looked for by the files' statistics.
FREQUENT, LISTED = 512, 1000


def factor(tf: Column, length: Column, avg_len: Column, k1: float, b: float) -> Column:
    """What a posting adds for a term of weight 1."""
    ratio = F.coalesce(length / F.nullif(avg_len, F.lit(0.0)), F.lit(0.0))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


def window(pos: Column, length: Column, width: Column) -> Column:
    """The window of a document, as a number made of its length's class and its place."""
    return F.floor(STEPS * F.log2(length + F.lit(1.0))) * F.lit(1 << 48) + F.floor(pos / width)


@dataclass(frozen=True)
class BlockIndex:
    """``blocks(term, frequent, block, n, peak, hits)``, ``terms(term, df, frequent)``, one row ``stats(n, avg_len, k1, b, width)``."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    def postings(self) -> ranking.Index:
        """The same postings one a row, for scores of all documents."""
        tf = self.blocks.select("term", F.explode("hits").alias("h")).select(F.col("h.pos").alias(POSITION), F.col("h.len").alias("len"), "term", F.col("h.tf").alias("tf"))
        return ranking.Index(tf, self.terms.select("term", "df"), self.stats.select("n", "avg_len"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in ("blocks", "terms", "stats")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings ``(term, frequent, block, _pos, tf, len, part)`` as a row a block; a block may go on in the next batch."""

    def rows(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        pos, tf, length = (part.column(c).combine_chunks() for c in (POSITION, "tf", "len"))
        ends = np.append(starts, len(part))
        hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pos, tf, length], ["pos", "tf", "len"]))
        first = part.select(["term", "frequent", "block"]).take(pa.array(starts)).combine_chunks()
        peak = np.maximum.reduceat(part.column("part").to_numpy(), starts)
        columns = [*(c.combine_chunks() for c in first.columns), pa.array(np.diff(ends), pa.int32()), pa.array(peak), hits]
        return pa.RecordBatch.from_arrays(columns, ["term", "frequent", "block", "n", "peak", "hits"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        term = held.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.append(0, np.flatnonzero((np.diff(term) != 0) | (np.diff(held.column("block").to_numpy()) != 0)) + 1)
        if len(starts) > 1:
            yield rows(held.slice(0, starts[-1]), starts[:-1])
        held = held.slice(starts[-1])
    if held is not None:
        yield rows(held, np.array([0]))


def write_blocks(texts: DataFrame, path: str, *, k1: float = ranking.K1, b: float = ranking.B, width: int = WIDTH, frequent: int = FREQUENT) -> BlockIndex:
    """Build the index of ``(_pos, text)`` under ``path``."""
    spark = texts.sparkSession
    counted(texts).write.mode("overwrite").parquet(f"{path}/tf")
    rows = spark.read.parquet(f"{path}/tf")
    tf = rows.where("term is not null")
    tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("frequent", F.col("df") >= frequent).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    stats = rows.where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    stats = stats.select("n", "avg_len", F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(width).alias("width"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    avg = spark.read.parquet(f"{path}/stats").select("avg_len")  # one row
    # Few terms are frequent, so the planner sends them to the postings.
    marked = tf.join(terms.where("frequent").select("term", "frequent"), "term", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False))).crossJoin(avg)
    block = F.when(F.col("frequent"), window(F.col(POSITION), F.col("len"), F.lit(width))).otherwise(F.floor(F.col(POSITION) / F.lit(ZONE))).alias("block")
    part = factor(F.col("tf"), F.col("len"), F.col("avg_len"), k1, b).alias("part")
    # One shuffle: what is dealt by term and block is sorted, packed and written where it is.
    dealt = marked.select("term", "frequent", block, POSITION, "tf", "len", part).repartition("term", "block").sortWithinPartitions("term", "block", POSITION)
    hits = "array<struct<pos: long, tf: int, len: int>>"
    dealt.mapInArrow(_pack, f"term string, frequent boolean, block long, n int, peak double, hits {hits}").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    return BlockIndex.load(spark, path)


@dataclass(frozen=True)
class Found:
    """``top(qid, _pos, score, rank)`` and ``read(qid, blocks, read)``: the blocks of a question's terms and those whose postings were read."""

    top: DataFrame
    read: DataFrame


def best(index: BlockIndex, asked: DataFrame, k: int, *, first: int = 8) -> Found:
    """The best ``k`` of each question ``(qid, question)``; the ``first`` windows of largest bound are scored before the others."""
    weight = F.col("qtf") * ranking.idf(F.col("n"), F.col("df"))
    terms = ranking.question_terms(asked).join(index.terms, "term").crossJoin(index.stats)  # stats is one row
    terms = checkpointed(terms.select("qid", "term", "frequent", weight.alias("w"), "avg_len", "k1", "b", "width").where("w > 0"))
    listed = [r.term for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    blocks = index.blocks.where(F.col("term").isin(listed)) if len(listed) <= LISTED else index.blocks
    asked_for = lambda frequent: terms.where("frequent" if frequent else "not frequent")

    def parts(joined: DataFrame) -> DataFrame:
        hits = joined.select("qid", "w", "avg_len", "k1", "b", "width", F.explode("hits").alias("h"))
        ratio = F.coalesce(F.col("h.len") / F.nullif(F.col("avg_len"), F.lit(0.0)), F.lit(0.0))
        part = F.col("w") * F.col("h.tf") * (F.col("k1") + 1) / (F.col("h.tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * ratio))
        return hits.select("qid", F.col("h.pos").alias(POSITION), window(F.col("h.pos"), F.col("h.len"), F.col("width")).alias("block"), part.alias("part"))

    rare = parts(blocks.where("not frequent").join(asked_for(False).drop("frequent"), "term"))
    rare = checkpointed(rare.groupBy("qid", POSITION, "block").agg(F.sum("part").alias("part")))
    heads = blocks.where("frequent").select("term", "block", "peak").join(asked_for(True), "term")
    heads = checkpointed(heads.select("qid", "term", "block", (F.col("w") * F.col("peak")).alias("most")))
    each = heads.select("qid", "block", "most").unionByName(rare.groupBy("qid", "block").agg(F.max("part").alias("most")))
    bounds = checkpointed(each.groupBy("qid", "block").agg(F.sum("most").alias("bound")))

    def scored(windows: DataFrame) -> DataFrame:
        chosen = windows.select("qid", "block")
        some = heads.select("qid", "term", "block").join(chosen, ["qid", "block"]).join(asked_for(True).drop("frequent"), ["qid", "term"])
        near = parts(blocks.where("frequent").select("term", "block", "hits").join(some, ["term", "block"])).select("qid", POSITION, "part")
        far = rare.join(chosen, ["qid", "block"]).select("qid", POSITION, "part")
        return near.unionByName(far).groupBy("qid", POSITION).agg(F.sum("part").alias("score")).where("score > 0")

    order = ranking.Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    begun = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= first)
    leading = checkpointed(ranking.top_k(scored(begun), k))
    floor = leading.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    # Sums differ in their last digits by order, and ranks go by nine digits.
    rest = bounds.join(begun.select("qid", "block"), ["qid", "block"], "left_anti").join(floor, "qid", "left").where(F.col("bound") + 2e-9 >= F.coalesce("floor", F.lit(0.0)))
    rest = checkpointed(rest.select("qid", "block"))
    top = ranking.top_k(leading.drop("rank").unionByName(scored(rest)), k)
    opened = rest.unionByName(begun.select("qid", "block")).join(heads.select("qid", "block"), ["qid", "block"]).groupBy("qid").agg(F.count("*").alias("read"))
    read = heads.groupBy("qid").agg(F.count("*").alias("blocks")).join(opened, "qid", "left").select("qid", "blocks", F.coalesce("read", F.lit(0)).alias("read"))
    return Found(top, read)
