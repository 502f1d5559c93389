"""Line dedup in SQL functions alone: count distinct documents per line hash, drop frequent lines, reassemble.

Lines are cut at newlines; a line's key has blanks stripped at both ends and A-Z lowered.  Each document sends
one row per distinct key hash, counted with map-side combination, so no line text is shuffled by its (possibly
very frequent) hash.  Hashes over the threshold are written; up to ``MOST`` of them are looked up in the scan
itself, so no text is shuffled at all.  More than that are joined with the hashes of the lines and come back to
the documents as the positions to drop.  Both ways drop the same lines, and put the others together by position
inside the row.

Keys are compared by two independent 64-bit hashes together.  Each row is a document of its own.

Defined cases: a null or empty text is one empty line, whose key is too short to be dropped; rows with equal
id and text are dropped from alike; null ids are handled like others.  Other columns, whatever their names,
are passed on only inside the struct ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support

BLANKS = " \t\n\x0b\x0c\r"
#: Frequent hashes that a plan takes as a set of numbers (at most 16 bytes each).
MOST = 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def drop_frequent_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, columns: bool = False, most: int = MOST
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text``; with ``columns`` also the whole input row as the struct ``doc``.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents have lose all their lines.
    """
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    self_key = F.struct(F.col(id_col).alias("i"), F.xxhash64(whole).alias("x"), F.hash(whole).alias("y"))
    keys = F.transform(lines, line_key)
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))
    keyed = docs.select(self_key.alias("self"), hashes.alias("hs"))

    counted = keyed.select(F.explode(F.array_distinct("hs")).alias("h")).where("h is not null")
    frequent = counted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(F.col("h").alias("f"))
    # Written, so that their number is known, and a join with all lines is planned by their size.
    frequent = support.materialize(frequent, "frequent")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if columns else []
    few = frequent.limit(most + 1).collect()
    if len(few) <= most:
        rows = docs.select(F.col(id_col).alias("doc_id"), whole.alias("whole"), lines.alias("ls"), hashes.alias("hs"), *own)
        lookup = (lambda h: _among(h, [r.f for r in few])) if few else (lambda h: F.lit(False))
        # Two arrays walked together, because the planner would compute an array that a function looks into at each of its steps.
        left = F.zip_with("ls", "hs", lambda x, h: F.when(~lookup(h), x))
        joined = rows.select("doc_id", "whole", left.alias("left"), *(["doc"] if columns else []))
        n, gone = F.size("left"), F.size(F.filter("left", lambda x: x.isNull()))
        text = F.when(gone == 0, F.col("whole")).otherwise(F.array_join("left", "\n"))  # nulls are left out
    else:
        placed = keyed.select("self", F.posexplode("hs").alias("pos", "h")).where("h is not null")
        gone = placed.join(frequent, F.col("h") == F.col("f")).groupBy("self").agg(F.collect_set("pos").alias("gone"))
        rows = docs.select(F.col(id_col).alias("doc_id"), self_key.alias("me"), whole.alias("whole"), *own)
        # The id may be null inside the struct, so the key is compared null-safely.
        joined = rows.join(gone, F.col("me").eqNullSafe(F.col("self")), "left")
        cut = F.split("whole", "\n", -1)
        kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone")))
        put = F.transform(F.array(cut), lambda c: F.array_join(F.transform(kept, lambda i: F.get(c, i)), "\n"))
        n, gone = F.size(cut), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
        text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.get(put, F.lit(0)))
    return joined.select("doc_id", n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), text.alias("kept_text"), *(["doc"] if columns else []))


def _among(h: Column, hashes: list) -> Column:
    """Whether a line's pair of hashes is one of ``hashes``; both halves are looked up."""
    one = lambda part: h[part].isin(*[F.lit(x) for x in dict.fromkeys(getattr(f, part) for f in hashes)])
    return F.coalesce(one("a") & one("b"), F.lit(False))
