"""Removal of recurring passages: every word inside a window of ``span`` words that starts more than once.

1. Each window is owned by its minimum k-gram (the last of equal ones), so equal windows have equal owners.
   A text sends one row per owner: the k-gram, and a hash of all the windows it owns there.
2. Passages are confirmed.  An owner group found twice is a passage: all its windows recur.  Where one k-gram
   owns several different groups, one text of each group is read again and its windows are counted singly;
   runs of windows that recur are passages.  So rows number a fourteenth of the words, and copies collapse
   before they are expanded.
3. Documents are dealt into shards by their smallest flagged k-gram, so that copies mostly meet in one shard;
   a k-gram that more documents have than a shard takes is dealt to several shards.  A shard asks for the
   passages whose owner groups its documents have, each once however many of its documents share it; their
   words are read from one confirmed example each.  Nothing says where a document has them.
4. Each shard compiles an Aho-Corasick automaton over word numbers from its passages and streams its documents
   through it, which locates every occurrence; the words covered are removed.  Documents without any flagged
   owner have no passage and are not shuffled.

A passage found anywhere covers recurring windows only, and each recurring window lies in a confirmed passage
of its own owner, so the words located are exactly those to remove.  An automaton is bounded by its shard
(``shard_chars`` on average, more only for a longer text).  A passage that a third of all documents share is
one row a group when counted and one row a shard when asked for, never one large group of documents.

Keys are 128 bits wide (owner and group, or owner and window).

Defined cases: a null or wordless text has no words; repeated rows and ids give one row each and count as
separate occurrences; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import BASE, U64, Bag, as_long, covered, grams, make_room, mix, sliding_argmin, slices, space_words

_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any word ranges of an array by prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * _powers(BASE, len(h)), dtype=U64)])
        self.back = _powers(_INVERSE, len(h) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] ^ (b - a).astype(U64))


def owners(bag: Bag, k: int, span: int) -> tuple[np.ndarray, ...]:
    """Per owner: place, first and last window start, k-gram hash, hash of its windows."""
    nothing = (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2
    if len(bag.h) < span:
        return nothing
    g = grams(bag.h, k)
    at = sliding_argmin(g, span - k + 1)
    start = np.flatnonzero(bag.left()[: len(at)] >= span)
    if not len(start):
        return nothing
    owner = at[start]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bag.doc[start][1:] != bag.doc[start][:-1])]))
    lo = start[new]
    hi = start[np.concatenate([new[1:], [len(start)]]) - 1]
    p = owner[new]
    group = mix(Ranges(bag.h).of(lo, hi + span) * BASE + ((p - lo) * 4096 + (hi - lo)).astype(U64))
    return p, lo, hi, g[p], group


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 35, k: int = 8, shard_chars: int = 1 << 22
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (null where nothing was removed)."""
    kind = support.type_of(docs, id_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cut = [space_words(t) for t in texts[a:b]]
                bag = Bag(cut)
                p, lo, hi, gram, group = owners(bag, k, span)
                d = bag.doc[p] if len(p) else np.empty(0, np.int64)
                at = np.searchsorted(d, np.arange(len(cut) + 1)).astype(np.int32)
                first = bag.at[d]
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (
                    (lo - first).astype(np.int32), (hi - first).astype(np.int32), (p - first).astype(np.int32), as_long(gram), as_long(group))]
                whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + b - a), pa.int64()), *(c.slice(a, b - a) for c in batch.columns), pa.array(bag.n, pa.int64()), pa.array(whole), *lists],
                    ["row", "doc_id", "text", "n_words", "whole", *OWNER],
                )
                row += b - a

    # Texts are written with their row numbers, which no later run of the scan has to give again.
    seen = support.materialize(docs.mapInArrow(support.lean(scan), f"row long, doc_id {kind}, text string, n_words long, whole string, {_LISTS}"), "owners")
    texts = seen.select("row", "text")
    often = seen.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    often = support.materialize(often, "often")
    rows = _flagged(seen, support.bitmap(often, F.col("gram")), "gram")
    groups = rows.groupBy("gram", "grp").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi", "p")).alias("at"))
    groups = support.materialize(groups, "groups")
    several = groups.groupBy("gram").agg(F.count("*").alias("ways"), F.sum("n").alias("all")).where("all > 1")
    recurring = support.materialize(groups.join(several, "gram").select("gram", "grp", "n", "ways", "at.*"), "recurring")

    support.discard(often, groups)

    # Windows of grams that own different groups, counted singly from one text of each group.
    asked = recurring.where("ways > 1").groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "p", "gram", "grp", "n")).alias("qs"))
    asked = support.materialize(asked, "asked")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, qs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bag = Bag([space_words(text)])
                lo, hi, p, gram, grp, n = (np.array([q[f] for q in qs], np.int64) for f in ("lo", "hi", "p", "gram", "grp", "n"))
                size = hi - lo + 1
                ends = np.cumsum(size)
                start = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
                win = as_long(mix(Ranges(bag.h).of(start, start + span) * BASE + (np.repeat(p, size) - start).astype(U64)))
                wins = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(win))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(grp), pa.array(n), wins], ["gram", "grp", "n", "wins"])

    singly = support.rows_of(texts, asked).select("text", "qs").mapInArrow(support.lean(windows), "gram long, grp long, n long, wins array<long>")
    singly = support.materialize(singly, "windows")
    each = singly.select("gram", "grp", "n", F.posexplode("wins").alias("step", "win"))
    twice = each.groupBy("gram", "win").agg(F.sum("n").alias("all")).where("all > 1").select("gram", "win")
    steps = each.where("n = 1").join(twice, ["gram", "win"], "left_semi").groupBy("gram", "grp").agg(F.sort_array(F.collect_set("step")).alias("steps"))
    confirmed = recurring.join(steps, ["gram", "grp"], "left").where("n > 1 or steps is not null")
    confirmed = confirmed.select("gram", "grp", "lo", "hi", F.col("row").alias("example"), F.when(F.col("n") == 1, F.col("steps")).alias("steps"))
    confirmed = support.materialize(confirmed, "confirmed")
    support.discard(recurring, asked, singly)

    # What each shard asks for, and the words of it.
    told = texts.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_shards = max(1, -(-told.chars // shard_chars))
    per_shard = max(1, told.rows // n_shards)
    flags = support.bitmap(confirmed, F.col("gram").bitwiseXOR(F.col("grp")))
    calls = support.materialize(_flagged(seen, flags, "gram", "grp").select("row", "gram", "grp", "least", "first"), "calls")
    crowded = calls.where("first").groupBy("least").agg(F.ceil(F.count("*") / F.lit(per_shard)).alias("parts")).where("parts > 1")
    crowded = support.materialize(crowded.select(F.col("least").alias("l"), "parts"), "crowded")  # fewer than there are shards
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64("least", part), F.lit(n_shards)).alias("shard")
    dealt = lambda df: df.join(crowded, F.col("least") == F.col("l"), "left")
    wanted = dealt(calls).select(shard, "gram", "grp").distinct().join(confirmed, ["gram", "grp"])
    wanted = wanted.groupBy("shard", F.col("example").alias("row")).agg(F.collect_list(F.struct("lo", "hi", "steps")).alias("parts"))
    wanted = support.materialize(wanted, "wanted")

    def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The passages of an example that one shard wants: runs of words, and the bounds of the passages in them."""
        for batch in batches:
            out = []
            for of, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = space_words(text)
                bounds = np.array(sorted({b for part in parts for b in _bounds(part, span)}), np.int64)
                flags = covered(len(words), bounds[:, 0], bounds[:, 1] - bounds[:, 0])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for a, b in edge.reshape(-1, 2):
                    inside = bounds[(bounds[:, 0] >= a) & (bounds[:, 1] <= b)] - a
                    out.append((of, b" ".join(words[a:b]).decode("utf-8", "surrogatepass"), inside.ravel()))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            types = (pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "text", "bounds"])

    passages = support.rows_of(texts, wanted).select("shard", "text", "parts").mapInArrow(support.lean(cut_passages), "shard long, text string, bounds array<int>")
    streamed = dealt(_called(seen, flags)).select(shard, "row", "text", F.lit(None).cast("array<int>").alias("bounds"))
    # In each shard the passages come first, so one pass compiles the automaton and streams the documents.
    both = passages.select("shard", F.lit(-1).cast("long").alias("row"), "text", "bounds").unionByName(streamed)
    cleaned = both.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(support.lean(_locate), "row long, n_removed long, kept string, kept_text string")
    out = seen.select("doc_id", "row", "n_words", "whole").join(cleaned, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"), "kept_text"
    )


OWNER = ("lo", "hi", "p", "gram", "grp")
_LISTS = "lo array<int>, hi array<int>, p array<int>, gram array<long>, grp array<long>"


def _hits(batch: pa.RecordBatch, at: int, flags: support.Flags, key: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Owners in the list columns from ``at``, the places of those whose XOR of ``key`` is flagged, and their rows in the batch."""
    flat = [c.flatten().to_numpy() for c in batch.columns[at:]]
    slot = flat[OWNER.index(key[0])]
    for c in key[1:]:
        slot = slot ^ flat[OWNER.index(c)]
    keep = np.flatnonzero(flags.has(slot))
    return flat, keep, np.repeat(np.arange(batch.num_rows), batch.column(at).value_lengths().to_numpy())[keep]


def _flagged(seen: DataFrame, flags: support.Flags, *key: str) -> DataFrame:
    """The flagged owners ``row, lo, hi, p, gram, grp`` of all texts, the ``least`` k-gram of them in each text, and its ``first``."""
    shared = seen.sparkSession.sparkContext.broadcast(flags.packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = support.Flags(shared.value)
        for batch in batches:
            flat, keep, of = _hits(batch, 1, local, key)
            gram = flat[OWNER.index("gram")][keep]
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            least = np.minimum.reduceat(gram, np.flatnonzero(first)) if len(of) else gram
            cols = [batch.column(0).to_numpy()[of], *(c[keep] for c in flat), least[np.cumsum(first) - 1], first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", *OWNER, "least", "first"])

    return seen.select("row", *OWNER).mapInArrow(support.lean(run), "row long, lo int, hi int, p int, gram long, grp long, least long, first boolean")


def _called(seen: DataFrame, flags: support.Flags) -> DataFrame:
    """``row, text, least`` of the texts that have a flagged owner."""
    shared = seen.sparkSession.sparkContext.broadcast(flags.packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = support.Flags(shared.value)
        for batch in batches:
            flat, keep, of = _hits(batch, 2, local, ("gram", "grp"))
            rows, at = np.unique(of, return_index=True)
            if len(rows):
                least = np.minimum.reduceat(flat[OWNER.index("gram")][keep], at)
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(rows)).columns, pa.array(least)], ["row", "text", "least"])

    return seen.select("row", "text", *OWNER).mapInArrow(support.lean(run), "row long, text string, least long")


def _bounds(part: dict, span: int) -> list[tuple[int, int]]:
    """First and end word of the passages in a confirmed group: all of it, or the runs of its recurring windows."""
    lo, steps = part["lo"], part["steps"]
    if steps is None:
        return [(lo, part["hi"] + span)]
    steps = np.array(steps)
    cut = np.flatnonzero(np.diff(steps) > 1) + 1
    return [(lo + int(run[0]), lo + int(run[-1]) + span) for run in np.split(steps, cut)]


class _Shard:
    """Passages of one shard and their automaton over word numbers; words that no passage has are 0.

    A word is two symbols of few values each, because a state's next states are searched one after the other.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.passages: set[tuple[int, ...]] = set()
        self.automaton = None

    @staticmethod
    def symbols(code: Sequence[int]) -> tuple[int, ...]:
        code = np.array(code, np.int32)
        return tuple(np.stack([code >> 8, (code & 255) + (1 << 24)], axis=1).ravel().tolist())

    def add(self, words: list[bytes], bounds: list[int]) -> None:
        code = [self.number.setdefault(w, len(self.number) + 1) for w in words]
        self.passages.update(tuple(code[a:b]) for a, b in zip(bounds[::2], bounds[1::2], strict=True))

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for passage in self.passages:
            self.automaton.add_word(self.symbols(passage))
        self.passages.clear()
        self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Flags of the words inside any passage."""
        if self.automaton is None and self.passages:
            self.compile()
        if self.automaton is None:
            return np.zeros(len(words), bool)
        number = self.number
        met = self.automaton.iter(self.symbols([number.get(w, 0) for w in words]))  # last symbol and symbols of each match
        last, size = np.fromiter(chain.from_iterable(met), np.int64).reshape(-1, 2).T >> 1
        return covered(len(words), last - size + 1, size)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with removed words, of rows ``shard, row, text, bounds`` sorted by shard with its passages (row -1) first."""
    now, shard = None, _Shard()
    for batch in batches:
        out = []
        for of, row, text, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != now:
                now, shard = of, _Shard()
            words = space_words(text)
            if row < 0:
                shard.add(words, bounds)
                continue
            gone = shard.covered(words)
            if gone.any():
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                out.append((row, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "n_removed", "kept", "kept_text"])
