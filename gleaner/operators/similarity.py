"""Exact set-similarity self-join: prefix, length and positional filters over tokens in order of rarity.

Equal sets are one node.  A node's tokens (64-bit hashes) are ordered from rare to frequent; two sets of n and m
tokens that are similar enough share a token in the first n - ceil(t n) + 1 of each, so only these prefixes are
shuffled.  The order is the same everywhere, which is all that exactness needs; the frequencies that it comes from are
those of the ``FREQUENT`` most frequent tokens (a bounded table), the others go by their hash.

A bucket holds the nodes with one prefix token and one class of sizes (a node of the next class visits it, because
similar sets are at most one class apart).  No bucket is expanded into all its pairs at once: its members are first
compared with its smallest node, which settles groups of near copies in linear work; then only members of different
groups are paired, where lengths and positions leave the overlap that is needed.  A bucket of more than ``hot`` members
is dealt to blocks, so that no task reads a whole one.

Few pairs that share a rare token are similar, so none meets its whole sets before its signatures allow it.  A signature
has the parity of the number of tokens for each of its bits; bits in which two differ are at most the tokens that only
one of the sets has, so no similar pair is lost.  Members of buckets bring a short one, candidates are joined with a long one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.components import components
from gleaner.session import checkpointed, spread

FREQUENT = 1 << 16
HOT = 1024
#: Words of 64 bits in the signatures: those that bucket members bring, that candidates are joined with, and that the rest of them is.
SHORT, LONG, LONGEST = 4, 16, 128


def permille(threshold: float) -> int:
    """The threshold in thousandths, so that sizes are compared as integers."""
    share = round(1000 * threshold)
    if not 0 < share <= 1000:
        raise ValueError("threshold must be above 0 and at most 1")
    return share


def similar(inter: Column, a: Column, b: Column, share: int) -> Column:
    return 1000 * inter >= share * (a + b - inter)


def nodes_of(rows: DataFrame, tokens: Column, id_: Column) -> DataFrame:
    """``node, ids, n, lead, copies``: every distinct token set once, with the smallest id that has it; written."""
    sets = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    grouped = rows.select(sets.alias("ids"), id_.alias("id")).groupBy("ids").agg(F.min("id").alias("lead"), F.count("*").alias("copies"))
    return checkpointed(grouped.select(F.monotonically_increasing_id().alias("node"), "ids", F.size("ids").alias("n"), "lead", "copies"))


def signatures(nodes: DataFrame, words: int) -> DataFrame:
    """``node, n, sig`` with ``sig`` an array of ``words`` longs: for each bit whether the tokens that fall on it are odd in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 64 * words
        for batch in batches:
            sizes = np.asarray(batch.column(2), np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes) * width + batch.column(1).flatten().to_numpy(zero_copy_only=False) % width
            odd = (np.bincount(at, minlength=len(sizes) * width) & 1).astype(np.uint8)
            packed = pa.array(np.packbits(odd).view(np.int64))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * words, pa.int32()), packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sig], ["node", "n", "sig"])

    return nodes.select("node", "ids", "n").mapInArrow(run, "node long, n int, sig array<long>")


def prefixes(nodes: DataFrame, share: int, most: int = FREQUENT) -> DataFrame:
    """``node, n, token, at`` for the prefix of every set in order of rarity; ``at`` is the place in that order."""
    counted = nodes.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    common = counted.orderBy(F.desc("n"), "token").limit(most).toArrow().column("token").to_numpy()
    by_hash = np.argsort(common)
    shared = nodes.sparkSession.sparkContext.broadcast((common[by_hash], len(common) - by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            ids, sizes = batch.column(1), np.asarray(batch.column(2), np.int64)
            token = ids.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.zeros(len(token), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                order = np.where(known[at] == token, rank[at], 0)
            placed = np.lexsort((token, order, row))
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            length = sizes - -(-share * sizes // 1000) + 1
            at = np.arange(len(token)) - np.repeat(start, sizes)
            keep = at < np.repeat(length, sizes)
            own = row[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), pa.array(sizes[own], pa.int32()), pa.array(token[placed][keep]), pa.array(at[keep], pa.int32())], ["node", "n", "token", "at"]
            )

    return nodes.where("n > 0").select("node", "ids", "n").mapInArrow(run, "node long, n int, token long, at int")


def _buckets(prefix: DataFrame, share: int) -> DataFrame:
    """``token, class, node, n, at, own`` of buckets with several nodes; ``own`` tells members from visitors."""
    if share == 1000:
        size = F.col("n")
    else:
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1000 / share) + 1e-9))  # a little wide, for rounding
    visits = F.array(F.struct(size.alias("class"), F.lit(True).alias("own")), F.struct((size - 1).alias("class"), F.lit(False).alias("own")))
    each = prefix.select("token", "node", "n", "at", F.explode(visits).alias("v")).select("token", "v.class", "node", "n", "at", "v.own")
    bucket = Window.partitionBy("token", "class")
    told = each.withColumns({"members": F.count("*").over(bucket), "least": F.min(F.struct("node", "n", "at")).over(bucket), "some": F.bool_or("own").over(bucket)})
    return checkpointed(told.where("members > 1 and some").drop("some"))


def _possible(n: Column, at: Column, m: Column, to: Column, share: int) -> Column:
    """Whether sets of ``n`` and ``m`` tokens whose first common token has these places may have the overlap that is needed."""
    return (1000 * F.least(n, m) >= share * F.greatest(n, m)) & (F.least(n - at, m - to) * (1000 + share) >= share * (n + m))


def _near(a: Column, b: Column, n: Column, m: Column, share: int) -> Column:
    """Whether sets of ``n`` and ``m`` tokens with signatures ``a`` and ``b`` may be similar enough."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda k, x: k + x)
    return (1000 + share) * differ <= (1000 - share) * (n + m)


def candidates(pairs: DataFrame, nodes: DataFrame, signed: DataFrame, share: int) -> DataFrame:
    """The pairs ``(u, v)`` whose signatures allow that they are similar, written; large sets need a longer one than ``signed`` has."""

    def kept(pairs: DataFrame, signed: DataFrame) -> DataFrame:
        end = lambda c: signed.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(end("u"), "u").join(end("v"), "v")
        return checkpointed(both.where(_near(F.col("sig_u"), F.col("sig_v"), F.col("n_u"), F.col("n_v"), share)).select("u", "v"))

    some = kept(pairs, signed)
    ends = some.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return kept(some, checkpointed(signatures(nodes.join(ends, "node", "left_semi"), LONGEST)))


def verified(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    left = pairs.join(nodes.select(F.col("node").alias("u"), F.col("ids").alias("a")), "u")
    both = left.join(nodes.select(F.col("node").alias("v"), F.col("ids").alias("b")), "v")
    inter = F.size(F.array_intersect("a", "b"))
    return both.where(similar(inter, F.size("a"), F.size("b"), share)).select("u", "v")


def _pairs(buckets: DataFrame, share: int, hot: int) -> DataFrame:
    """Pairs of one bucket, from different groups, that lengths and positions leave possible."""
    blocks = F.ceil(F.col("members") / F.lit(hot)).cast("int")
    own = F.pmod(F.hash("node"), blocks)
    dealt = buckets.select("*", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    a = dealt.where("own").select("token", "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "root", "sig")])
    b = dealt.select("token", "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("block_b"), "own", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root", "sig")])
    # Within one block the pair meets in (i, i) only; members of one bucket are ordered by node.
    once = F.when(F.col("i") == F.col("j"), F.lit(True)).otherwise(F.col("block") != F.col("block_b"))
    order = ~F.col("own") | (F.col("node_a") < F.col("node_b"))
    near = _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), share) & _near(F.col("sig_a"), F.col("sig_b"), F.col("n_a"), F.col("n_b"), share)
    met = a.join(b, ["token", "class", "i", "j"]).where(once & order & (F.col("root_a") != F.col("root_b")) & near)
    return met.select(F.least("node_a", "node_b").alias("v"), F.greatest("node_a", "node_b").alias("u")).distinct()


def similarity_groups(rows: DataFrame, tokens: Column, id_: Column, *, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """``lead, root, copies`` of every distinct token set: its smallest id and the smallest id of its group.

    Groups are the components of all links between sets of Jaccard similarity ``threshold`` or more.  Rows without
    tokens have the same set; a null id is passed over when there is another.
    """
    share = permille(threshold)
    nodes = nodes_of(spread(rows), tokens, id_)
    buckets = _buckets(prefixes(nodes, share), share)
    to_least = _possible(F.col("n"), F.col("at"), F.col("least.n"), F.col("least.at"), share)
    stars = buckets.where((F.col("node") != F.col("least.node")) & to_least).select(F.col("node").alias("u"), F.col("least.node").alias("v")).distinct()
    signed = checkpointed(signatures(nodes, LONG))
    links = checkpointed(verified(candidates(stars, nodes, signed, share), nodes, share))
    roots = components(links)
    named = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    loose = named.groupBy("token", "class").agg((F.min("root") != F.max("root")).alias("loose")).where("loose").select("token", "class")
    short = signatures(nodes, SHORT).select("node", "sig")
    open_ = named.join(loose, ["token", "class"], "left_semi").select("token", "class", "node", "n", "at", "own", "members", "root").join(short, "node")
    more = checkpointed(verified(candidates(_pairs(checkpointed(open_), share, hot), nodes, signed, share), nodes, share))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    placed = nodes.join(roots, "node", "left").select("node", "lead", "copies", F.coalesce("root", "node").alias("group"))
    least = placed.groupBy("group").agg(F.min("lead").alias("root"))
    return placed.join(least, "group").select("lead", "root", "copies")
