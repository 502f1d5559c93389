"""Spelling variants: frequent words at one edit, found by automata that walk compact trie shards.

Tasks count their words before the shuffle, so a hot word is one row a task.  The words frequent enough are sorted by
ranges; every range builds compact tries of at most ``SHARD_WORDS`` words and ``SHARD_BYTES`` of text: three flat
arrays (a byte for each node's letter, its first child, its count), in which the children of a node lie together.
All letters are below U+0100, so a letter is a byte and byte order is code-point order.

The shards are broadcast in rounds of at most ``ROUND_BYTES``, whatever the vocabulary; in a round every word's
distance-one automaton walks every shard depth-first.  The automaton follows the word itself and leaves it at each
place by one edit (another letter, one more, one less), behind which only the exact rest is accepted.  A shard far
from the word is left after its first nodes.  A word sends one row a round, its number of neighbours and the best of
them; a reduction puts the rounds together.  A form has at least twice its word's count, so chains of forms have at
most 63 steps and pointer doubling finds their ends in six joins.

Defined cases: a null or empty text has no words; a null id deletes no letter; rows with equal ids are documents of
their own that delete alike; a word may be as long as its text (a shard then holds it alone); ties between forms go to the
smallest word; an empty table or one without frequent words gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import make_room

SHARD_WORDS, SHARD_BYTES = 1 << 15, 2 << 20
#: Bytes of tries in one broadcast.
ROUND_BYTES = 32 << 20
#: Different words that a task counts before it sends them.
HELD = 200_000
#: Words that one task walks through the tries, about a second's work.
TASK_WORDS = 8192
#: ASCII other than letters to a blank; other bytes as they are.
_LETTERS = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
#: Characters beyond ASCII that are not U+00C0 to U+00FF (whose first byte is C3).
_FOREIGN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+|\xed[\xa0-\xbf][\x80-\xbf]")


def runs(text: str | None) -> list[bytes]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, as UTF-8."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS)
    return _FOREIGN.sub(b" ", data).split()


def _slip(run: bytes, h: int) -> bytes:
    """The run without the code point that its hash names."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str, text_col: str, slip: int, least: int) -> DataFrame:
    """``(word, n)`` of all words of at least ``least`` code points."""
    ids = F.concat(F.col(id_col).cast("string"), F.lit(":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        total: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode() for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = None if i is None else zlib.crc32(i.encode())
                for w, n in Counter(runs(text.as_py())).items():
                    if len(w) < least:
                        continue
                    if start is not None and not (h := zlib.crc32(w, start)) % slip:
                        w = _slip(w, h)
                    if len(w) >= 2 * least or len(w.decode()) >= least:
                        total[w] += n
                if len(total) > HELD:
                    yield sent()
                    total.clear()
        if total:
            yield sent()

    words = docs.select(ids.alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(support.lean(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


# -- tries ---------------------------------------------------------------------------------------------


def build(words: list[bytes], counts: list[int]) -> bytes:
    """The compact trie of sorted Latin-1 words: number of nodes, letters, first children, counts (0 inside).

    Nodes lie level by level, so the children of node v are ``first[v]`` to ``first[v + 1]``; node 0 is the root.
    """
    letters, first, ends = bytearray(b"\0"), [], []
    level = [(0, len(words))]
    depth = 0
    while level:
        below = []
        for lo, hi in level:
            first.append(len(letters))
            ends.append(0)
            if len(words[lo]) == depth:
                ends[-1] = counts[lo]
                lo += 1
            while lo < hi:
                c, end = words[lo][depth], lo + 1
                if words[hi - 1][depth] == c:
                    end = hi
                else:
                    while words[end][depth] == c:
                        end += 1
                letters.append(c)
                below.append((lo, end))
                lo = end
        level, depth = below, depth + 1
    first.append(len(letters))
    size = np.array([len(letters)], "<i8").tobytes()
    return b"".join([size, np.array(ends, "<i8").tobytes(), np.array(first, "<i4").tobytes(), bytes(letters)])


class Trie:
    """A built trie, read where its bytes lie."""

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        view = memoryview(blob)
        self.ends, self.first = view[8 : 8 + 8 * n].cast("q"), view[8 + 8 * n : 12 + 12 * n].cast("i")
        self.letters = blob[12 + 12 * n :]

    def near(self, w: bytes) -> dict[bytes, int]:
        """Words of the trie at exactly one insertion, deletion or replacement from ``w``, with their counts."""
        ends, first, letters, find = self.ends, self.first, self.letters, self.letters.find
        out: dict[bytes, int] = {}
        size = len(w)

        def rest(v: int, i: int) -> int:
            """The count behind the exact rest ``w[i:]`` below node v, 0 if it is no word."""
            while i < size:
                v = find(w[i], first[v], first[v + 1])
                if v < 0:
                    return 0
                i += 1
            return ends[v]

        v = 0
        for i in range(size + 1):
            a, b = first[v], first[v + 1]
            if i < size:
                own = w[i]
                before = w[i - 1] if i else -1  # taking or adding the letter before again gives the same words as there
                if own != before and (n := rest(v, i + 1)):
                    out[w[:i] + w[i + 1 :]] = n
                after = w[i + 1] if i + 1 < size else -1
                for u in range(a, b):
                    c = letters[u]
                    lo, hi = first[u], first[u + 1]
                    if c != own and (n := ends[u] if after < 0 else rest(x, i + 2) if (x := find(after, lo, hi)) >= 0 else 0):
                        out[w[:i] + letters[u : u + 1] + w[i + 1 :]] = n
                    if c != before and (x := find(own, lo, hi)) >= 0 and (n := rest(x, i + 1)):
                        out[w[:i] + letters[u : u + 1] + w[i:]] = n
                v = find(own, a, b)
                if v < 0:
                    break
            else:
                for u in range(a, b):
                    if n := ends[u]:
                        out[w + letters[u : u + 1]] = n
        return out


def shards(words: DataFrame, parts: int) -> DataFrame:
    """``(part, at, trie, bytes)``: bounded tries over the sorted ranges of ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        counts: list[int] = []
        size = 0

        def built() -> pa.RecordBatch:
            blob = build(held, counts)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([blob], pa.binary()), pa.array([len(blob)])], ["part", "at", "trie", "bytes"])

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                word = w.encode("latin-1")
                if held and (len(held) >= SHARD_WORDS or size + len(word) > SHARD_BYTES):
                    yield built()
                    at, size = at + 1, 0
                    held.clear()
                    counts.clear()
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield built()

    # UTF-8 and Latin-1 sort these letters alike.
    ranged = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ranged.mapInArrow(support.lean(run), "part long, at long, trie binary, bytes long")


def walk(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """``(word, n_near, form, form_n)`` of the words that have neighbours in the broadcast ``tries``."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = [Trie(t) for t in shared.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                w, near = word.encode("latin-1"), {}
                for trie in local:
                    near |= trie.near(w)
                if near:
                    best, n = min(near.items(), key=lambda x: (-x[1], x[0]))
                    rows.append((word, len(near), best.decode("latin-1"), n))
            if rows:
                word, count, form, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count, pa.int64()), pa.array(form), pa.array(n, pa.int64())], ["word", "n_near", "form", "form_n"])

    return words.select("word").mapInArrow(support.lean(run), "word string, n_near long, form string, form_n long")


def _rounds(made: DataFrame) -> Iterator[list[bytes]]:
    """Shards in groups of at most ``ROUND_BYTES`` (a larger one alone); the driver holds one group at a time."""
    group: list[tuple[int, int]] = []
    size = 0

    def read() -> list[bytes]:
        lo, hi = group[0], group[-1]
        at = F.struct("part", "at")
        key = lambda x: F.struct(F.lit(x[0]).cast("long").alias("part"), F.lit(x[1]).cast("long").alias("at"))
        return [bytes(r.trie) for r in made.where((at >= key(lo)) & (at <= key(hi))).select("trie").collect()]

    for r in made.select("part", "at", "bytes").orderBy("part", "at").toLocalIterator():
        if group and size + r.bytes > ROUND_BYTES:
            yield read()
            group, size = [], 0
        group.append((r.part, r.at))
        size += r.bytes
    yield read() if group else []


def follow(links: DataFrame, rounds: int = 7) -> DataFrame:
    """``(word, root)``, a written table, for ``links(word, form)`` without cycles: each round follows twice as far."""
    at = support.materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("w"), F.col("root").alias("further"))
        longer = at.drop("moved").join(on, F.col("root") == F.col("w"), "left")
        old, at = at, support.materialize(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        support.discard(old)
        if at.where("moved").isEmpty():
            return at.drop("moved")
    raise RuntimeError("chains of forms are longer than their counts allow")


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slip: int = 97, least_chars: int = 5, least_count: int = 3, factor: int = 2
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``least_chars`` and ``least_count`` or more.

    ``form`` is the most frequent word at one edit, if it has ``factor`` times the word's count; ``root`` is the end
    of the chain of forms.  A run whose hash ``slip`` divides loses a letter first.
    """
    if factor < 2:
        raise ValueError("a form must have at least twice its word's count, else chains may not end")
    frequent = count_words(docs, id_col, text_col, slip, least_chars).where(F.col("n") >= least_count)
    words = support.materialize(frequent, "words")
    n = words.count()
    made = support.materialize(shards(words, max(1, -(-n // SHARD_WORDS))), "tries")
    dealt = words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_WORDS)), "word")
    found = [support.materialize(walk(dealt, tries), "near") for tries in _rounds(made)]
    support.discard(made)
    # Most frequent first, then the smallest word.
    least = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    merged = reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best"))
    strong = -F.col("best.minus") >= factor * F.col("n")
    told = words.join(merged, "word", "left").select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.minus")).alias("form_n")
    )
    told = support.materialize(told, "forms")
    support.discard(words, *found)
    roots = follow(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
