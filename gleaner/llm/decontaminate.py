"""Benchmark decontamination by winnowed fingerprints, joined and extended to exact word matches.

A window is ``span`` consecutive words of a benchmark item (all words of a shorter item).  From every text the
minimum k-gram hash of each run of ``span - k + 1`` k-grams is kept, so any shared span of ``span`` words has a
fingerprint at the same place of both texts: no window can be missed.  Fingerprints of equal hash are
compared word by word within the one span around them, and only exactly equal windows count.  Items shorter
than a window are looked up whole, by hashes of their own length.

Document fingerprints are thinned before the shuffle by a bitmap of the benchmark's hashes, whose size is
fixed; the join itself is an equi-join on the hash, so the benchmark may be of any size.

Defined cases: null or wordless documents have no words, no hits and are clean; null or wordless items match
nothing; every input row gives one row, repeated ids included; items with one id count once; items
without an id count for hits and verdicts, but not for ``n_items`` and ``items_sha256``.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import U64, Bag, alnum_words, as_long, grams, mix, sliding_argmin, slices


def winnow(bag: Bag, k: int, span: int) -> np.ndarray:
    """Flags of the places whose k-gram is the minimum (the last of equal ones) of some span inside its document."""
    chosen = np.zeros(len(bag.h), bool)
    if len(bag.h) < span:
        return chosen
    at = sliding_argmin(grams(bag.h, k), span - k + 1)
    chosen[at[bag.left()[: len(at)] >= span]] = True
    return chosen


def _salted(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of different gram lengths do not meet."""
    return mix(h ^ U64(length * 0x10001))


_FOUND = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("lead", pa.int32()), ("ctx", pa.binary())]))


def _fingerprints(bag: Bag, docs: list, k: int, span: int, flags: support.Flags | None, short: tuple[int, ...]) -> list[list | None]:
    """Per document: hash, place, words before the gram in the context, and the context's words."""
    out: list[list | None] = [None] * len(docs)
    left = bag.left()
    for n, chosen in [(k, winnow(bag, k, span)), *((n, None) for n in short)]:
        h = grams(bag.h, n)
        ok = chosen[: len(h)].copy() if chosen is not None else left[: len(h)] >= n
        h = _salted(h, n if chosen is None else span)
        if flags is not None:
            ok &= flags.has(as_long(h))
        for p in np.flatnonzero(ok):
            d = bag.doc[p]
            at = int(p - bag.at[d])
            lead, tail = (min(at, span - n), span) if chosen is not None else (0, n)
            words = docs[d][at - lead : at + tail]
            if out[d] is None:
                out[d] = []
            out[d].append({"h": int(h[p].view(np.int64)), "p": at, "lead": lead, "ctx": b" ".join(words)})
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 13,
    k: int = 8,
    share: int = 20,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document is contaminated when it has hit words and ``share * n_hit >= n_words``.
    """
    kind = support.type_of(docs, id_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cut = [alnum_words(t) for t in texts[a:b]]
                bag = Bag(cut)
                found = _fingerprints(bag, cut, k, span, None, ())
                for i, words in enumerate(cut):  # a short item is one gram of its own length
                    if 0 < len(words) < span:
                        h = _salted(grams(bag.h[bag.at[i] : bag.at[i + 1]], len(words)), len(words))
                        found[i] = [{"h": int(as_long(h)[0]), "p": 0, "lead": 0, "ctx": b" ".join(words)}]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(w) for w in cut], pa.int32()), pa.array(found, _FOUND)], ["item_id", "n", "found"]
                )

    fields = "found array<struct<h: long, p: int, lead: int, ctx: binary>>"
    prints = items.mapInArrow(support.lean(of_items), f"item_id string, n int, {fields}")
    prints = support.materialize(prints.select("item_id", "n", F.explode("found").alias("f")).select("item_id", "n", "f.*"), "prints")
    flags = support.bitmap(prints, F.col("h"))
    short = tuple(r.n for r in prints.where(F.col("n") < span).select("n").distinct().collect())  # fewer than ``span`` lengths
    shared = docs.sparkSession.sparkContext.broadcast(flags.packed)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = support.Flags(shared.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cut = [alnum_words(t) for t in texts[a:b]]
                found = _fingerprints(Bag(cut), cut, k, span, local, short)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(range(row, row + b - a), pa.int64()),
                        pa.array([len(w) for w in cut], pa.int64()),
                        pa.array(found, _FOUND),
                    ],
                    ["doc_id", "row", "n_words", "found"],
                )
                row += b - a

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = support.materialize(base.mapInArrow(support.lean(of_docs), f"doc_id {kind}, row long, n_words long, {fields}"), "seen")
    probes = seen.where("found is not null").select("row", F.explode("found").alias("f")).select("row", "f.*")
    there = prints.select("h", "item_id", "n", F.col("lead").alias("item_lead"), F.col("ctx").alias("item_ctx"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words around a fingerprint, kept when they reach a whole window."""
        for batch in batches:
            rows, items_, ns, ps, leads, ctxs, item_leads, item_ctxs = (c.to_pylist() for c in batch.columns)
            out = []
            for row, item, n, p, lead, ctx, item_lead, item_ctx in zip(rows, items_, ns, ps, leads, ctxs, item_leads, item_ctxs, strict=True):
                if n < span:
                    if ctx == item_ctx:
                        out.append((row, item, p, p + n))
                    continue
                x, y = ctx.split(), item_ctx.split()
                gram = x[lead : lead + k]
                if gram != y[item_lead : item_lead + k]:
                    continue
                a, b = lead, item_lead
                while a and b and x[a - 1] == y[b - 1]:
                    a, b = a - 1, b - 1
                e, f = lead + k, item_lead + k
                while e < len(x) and f < len(y) and x[e] == y[f]:
                    e, f = e + 1, f + 1
                if e - a >= span:
                    out.append((row, item, p - lead + a, p - lead + e))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                ["row", "item_id", "a", "b"],
            )

    met = probes.join(there, "h").select("row", "item_id", "n", "p", "lead", "ctx", "item_lead", "item_ctx")
    spans = support.materialize(met.mapInArrow(support.lean(extend), "row long, item_id string, a int, b int").distinct(), "spans")
    # Words in any span: spans by start, each adding what reaches beyond all spans before it.
    before = F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    distinct = spans.select("row", "a", "b").distinct()
    hits = distinct.withColumn("seen", before).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("seen", F.lit(0))))).alias("n_hit")
    )
    names = spans.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = seen.select("doc_id", "row", "n_words").join(hits.join(names, "row"), "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
