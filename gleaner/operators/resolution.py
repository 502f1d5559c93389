"""Entity resolution: names within a few edits of each other, and all that they reach, are one entity.

Names are compared in blocks of rare character n-grams.  An edit changes at most three of a padded name's trigrams, so
two names within ``edits`` edits share one of the first 3 * edits + 1 trigrams in order of rarity, counted with their
repeats.  A block also names a length: names visit the blocks of lengths up to ``edits`` longer, so only those meet
whose lengths allow it.  Blocks with many names are dealt to sub-blocks; the engine's bounded edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.components import components
from gleaner.session import checkpointed

HOT = 512


def _blocks(names: DataFrame, edits: int) -> DataFrame:
    """``token, size, node, key, own``: each name under its rare trigrams, as a member of its length and a visitor of longer ones."""
    padded = F.concat(F.lit("\x01\x01"), F.col("key"), F.lit("\x02\x02"))
    grams = F.transform(F.sequence(F.lit(1), F.length("key") + 2), lambda i: F.substring(padded, i, F.lit(3)))
    each = names.select("node", "key", F.explode(grams).alias("gram"))
    again = each.groupBy("node", "key", "gram").agg(F.count("*").cast("int").alias("times"))
    tokens = again.select("node", "key", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.concat("gram", k.cast("string")))).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n"))
    placed = tokens.join(common, "token").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("n", "token")))
    rare = placed.where((F.col("at") <= 3 * edits + 1) & (F.col("n") > 1)).select("token", F.length("key").alias("size"), "node", "key")
    # Names so short that their edits may leave no trigram meet in one block of all short names.
    short = names.where(F.length("key") + 2 <= 3 * edits + edits).select(F.lit("").alias("token"), F.length("key").alias("size"), "node", "key")
    visits = F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda d: F.struct((F.col("size") + d).alias("size"), (d == 0).alias("own")))
    return rare.unionByName(short).select("token", "node", "key", F.explode(visits).alias("v")).select("token", "v.size", "node", "key", "v.own")


def close_names(names: DataFrame, *, edits: int, hot: int = HOT) -> DataFrame:
    """``(u, v)`` for the names ``(node, key)`` that are within ``edits`` edits."""
    blocks = checkpointed(_blocks(names, edits))
    sized = blocks.groupBy("token", "size").agg(F.count("*").alias("members"), F.bool_or("own").alias("some")).where("members > 1 and some")
    parts = F.ceil(F.col("members") / F.lit(hot)).cast("int")
    own = F.pmod(F.hash("node"), F.col("parts"))
    dealt = blocks.join(sized.select("token", "size", parts.alias("parts")), ["token", "size"])
    dealt = dealt.select("*", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    at = [F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    a = dealt.where("own").select("token", "size", *at, F.col("part").alias("part_a"), F.col("node").alias("a"), F.col("key").alias("key_a"))
    b = dealt.select("token", "size", *at, F.col("part").alias("part_b"), F.col("node").alias("b"), F.col("key").alias("key_b"), "own")
    once = (F.col("i") == F.col("j")) | (F.col("part_a") != F.col("part_b"))
    order = ~F.col("own") | (F.col("a") < F.col("b"))
    met = a.join(b, ["token", "size", "i", "j"]).where(once & order)
    # One distance for each pair, however many trigrams it shares.
    pairs = met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.struct("key_a", "key_b").alias("k")).groupBy("u", "v").agg(F.first("k").alias("k"))
    return pairs.where(F.levenshtein("k.key_a", "k.key_b", edits) >= 0).select("u", "v")


def resolve_names(df: DataFrame, name: str, *, edits: int = 1, hot: int = HOT) -> DataFrame:
    """The columns of ``df`` with ``canonical``, the name of its entity: the most frequent one, then the smallest.

    Names are compared without case and extra blanks; those within ``edits`` edits are one entity with all that they
    reach.  A null or blank name is an entity of its own without a name.
    """
    key = tx.collapse(F.col(f"`{name}`"))
    counted = df.select(key.alias("key"), F.col(f"`{name}`").cast("string").alias("name")).where("key <> ''").groupBy("key", "name").agg(F.count("*").alias("n"))
    by_key = counted.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "name")).alias("best"))
    names = checkpointed(by_key.select(F.monotonically_increasing_id().alias("node"), "key", "best"))
    roots = components(checkpointed(close_names(names.select("node", "key"), edits=edits, hot=hot)))
    placed = names.join(roots, "node", "left").select("key", "best", F.coalesce("root", "node").alias("root"))
    canon = placed.groupBy("root").agg(F.min("best").alias("least"))
    told = placed.join(canon, "root").select(F.col("key").alias("__key"), F.col("least.name").alias("canonical"))
    return df.join(told, key == F.col("__key"), "left").select(*[df[f"`{c}`"] for c in df.columns], "canonical")
