"""Near-duplicate grouping with SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds its distinct shingles (five lower-cased words; fewer words make one shingle).
Equal sets become one node.  A node's SuperMinHash signature gives band keys; nodes of one band bucket are
candidates, and a link counts only after both full sets were compared.

No bucket is expanded into pairs.  First each member is compared with its bucket's smallest node, which
settles a bucket of copies in linear work; the members of a crowded bucket are dealt into slices, each with
its own copy of that node's set, so no task reads a whole bucket.  Buckets that still hold several components
are then searched in blocks against blocks: signatures find members that may have a partner in another
component, parity bits of their sets rule most of those out (never a link), the sets of the rest alone meet, and each block reports a spanning forest of verified links.  So
no partner is capped or skipped, and one task never holds more than two blocks, whose number follows from the
members and from the bytes of their sets.

Recall: at similarity 0.75 one of 32 bands of 4 rows agrees with probability 0.316, so a link is missed with
probability 5e-6 (less above 0.75); nothing below the threshold is ever linked.  In the second search a pair
is passed over when its signatures agree in fewer places than six standard deviations below the threshold:
for two sets at 0.75 that has a probability of 8e-9 a pair (independent hashes; theirs vary less).

Defined cases: a null or wordless text has an empty set, is linked with nothing and keeps its own id; a null
id is ignored when a component takes its smallest id; repeated rows are grouped like any other copies;
other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import BASE, NONE, U64, Bag, as_long, grams, hashed, lower_space_words, mix, slices

CHUNK = 1 << 16
#: Members of a bucket that one copy of its smallest node's set is compared with, and bytes of sets in a block.
SLICE, BLOCK_BYTES = 2048, 4 << 20
#: Most parity bits of a set, which stand before the set itself in the second search.
PARITY = 1 << 16
#: Offsets that give each step of a signature its own hash of an element.
STRIDE = np.arange(1, 1025, dtype=U64) * BASE


def shingle_sets(texts: Sequence[str | None], n: int, words: Callable = lower_space_words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    docs = [words(t) for t in texts]
    bag = Bag(docs)
    whole = grams(bag.h, n)
    out = []
    for i, doc in enumerate(docs):
        a, b = bag.at[i], bag.at[i + 1]
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif doc:
            short = bag.h[a:b]
            acc = short[:1].copy()
            for x in short[1:]:
                acc = acc * BASE + x
            out.append(mix(acc ^ U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def superminhash(sets: Sequence[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values for each non-empty set.

    Element e sends value j + r(e, j) to place p(e, j) of a permutation that is its own, so ranks of the
    places are anti-correlated and the estimate varies less than with independent hashes.  Step j gives only
    values in [j, j + 1); a set stops after the step in which its last place is filled.
    """
    out = np.full((len(sets), m), NONE, U64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= CHUNK):
            size += len(sets[stop])
            stop += 1
        for lo in range(0, max(size, 1), CHUNK):  # only a set of its own has more than one part; minima merge
            part = [s[lo : lo + CHUNK] for s in sets[start:stop]]
            sig = _steps(np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part]), len(part), m)
            out[start:stop] = np.minimum(out[start:stop], sig)
        start = stop
    return out


def _steps(e: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    sig = np.full(rows * m, NONE, U64)
    if not len(e):
        return sig.reshape(rows, m)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
    open_places = np.full(rows, m)
    at = np.arange(len(e))
    for j in range(m):
        x = mix(e + STRIDE[j])
        k = j + ((x & U64(0xFFFFFFFF)) * U64(m - j) >> U64(32)).astype(np.int64)
        p = perm[at, k]
        perm[at, k] = perm[at, j]
        place = row * m + p
        free = sig[place] == NONE
        hit = place[free]
        np.minimum.at(sig, hit, (U64(j) << U64(32)) | (x[free] >> U64(32)))
        open_places -= np.bincount(np.unique(hit) // m, minlength=rows)
        live = open_places[row] > 0
        if not live.all():
            e, row, at = e[live], row[live], at[live]
            if not len(e):
                break
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands)).copy()
    for r in range(rows):
        acc = mix(acc * BASE + cut[:, :, r])
    return acc


def enough(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return enough(int((large[at] == small).sum()), len(a), len(b), percent)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 75,
    bands: int = 32,
    rows: int = 4,
    block: int = 512,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, first``.

    ``kept`` marks rows whose id is the smallest of their component; ``first`` marks exactly one row of each
    component even when ids are null or repeated.
    """
    m = bands * rows
    kind = support.type_of(docs, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("content", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                low: list = [None] * len(sets)
                if full:
                    sig = superminhash([sets[i] for i in full], m)
                    banded, tail = as_long(band_keys(sig, bands)), (sig & U64(255)).astype(np.uint8)
                    for i, k, t in zip(full, banded, tail, strict=True):
                        keys[i], low[i] = k, t.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(range(row, row + b - a), pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(low, pa.binary()),
                        batch.column(2).slice(a, b - a),
                    ],
                    ["doc_id", "row", "n", "set", "bands", "sig", "content"],
                )
                row += b - a

    signed = support.materialize(base.mapInArrow(support.lean(sign), f"doc_id {kind}, row long, n long, set binary, bands array<long>, sig binary, content long"), "signed")
    # Equal sets are one node, named by its smallest row; its text is read through that row's id and content, as ids may be null or repeat.
    grouped = signed.where("n > 0").groupBy("set").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "content"), "row").alias("home")
    )
    nodes = support.materialize(grouped, "nodes")
    reps = signed.select("row", "bands", "sig", "n").join(nodes.select(F.col("node").alias("row")), "row")
    banded = reps.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    members = support.materialize(banded.join(crowded, "key"), "members")

    pairs = members.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    # Sets whose sizes alone rule a link out are not read; sizes are narrow.
    size = lambda c: signed.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"))
    fits = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    pairs = pairs.join(size("u"), "u").join(size("v"), "v").where(fits).select("u", "v")
    sets = _Texts(base, nodes, signed, kind, shingle)
    links = _verify(pairs, sets, percent)
    roots = support.components(links)

    # Buckets that are not settled: members of several components (a node without links is its own).
    named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    loose = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).where("a < b")
    left = support.materialize(named.join(loose.select("key", "size"), "key"), "loose")
    marked = support.materialize(_may_link(left, signed, block, percent, m), "marked")
    if not marked.isEmpty():
        more = _link_blocks(marked, sets, percent, block)
        roots = support.components(links.unionByName(more))
        support.discard(more)
    support.discard(members, links, left, marked)

    of_set = nodes.join(roots, "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"), "node")
    ids = of_set.groupBy("root").agg(F.min("least").alias("component_id"), F.min("node").alias("lead"))
    placed = of_set.select("set", "root").join(ids, "root").select("set", "component_id", "lead")
    all_rows = signed.select("doc_id", "row", "n", "set").join(placed, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return all_rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.when(F.col("n") > 0, F.col("row") == F.col("lead")).otherwise(F.lit(True)).alias("first"),
    )


class _Texts:
    """Reads the texts of chosen nodes; only rows that a bitmap of their ids lets pass are shuffled."""

    def __init__(self, base: DataFrame, nodes: DataFrame, signed: DataFrame, kind: str, shingle: int):
        self.base, self.nodes, self.signed, self.kind, self.shingle = base, nodes, signed, kind, shingle

    def of(self, wanted: DataFrame) -> DataFrame:
        """``(node, shingles)``, one row for each distinct node in ``wanted(node)``."""
        need = self.nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("home.doc_id").alias("home"), F.col("home.content").alias("of"), "set")
        need = support.materialize(need, "need")
        near = support.pass_bitmap(self.base, F.xxhash64("doc_id", "content"), support.bitmap(need, F.xxhash64("home", "of")))
        both = near.join(need, (F.col("content") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("home")))
        shingle = self.shingle

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows whose text has the node's set, so that contents of one hash do no harm, with that set as bytes."""
            for batch in batches:
                texts = batch.column(2).to_pylist()
                for a, b in slices(texts):
                    part = [s.tobytes() for s in shingle_sets(texts[a:b], shingle)]
                    want = batch.column(1).slice(a, b - a).to_pylist()
                    ok = pa.array([xxhash.xxh3_128_digest(p) == w for p, w in zip(part, want, strict=True)])
                    whole = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(part, pa.binary())], ["node", "shingles"])
                    yield whole.filter(ok)

        found = both.select("node", "set", "text").mapInArrow(support.lean(same), "node long, shingles binary")
        sets = support.materialize(found, "sets")
        if sets.count() > need.count():  # rows that repeat both id and text
            once = support.materialize(sets.dropDuplicates(["node"]), "sets")
            support.discard(sets)
            sets = once
        support.discard(need)
        return sets


def _verify(pairs: DataFrame, sets: _Texts, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; a node with many partners is dealt to several slices."""
    pairs = support.materialize(pairs, "pairs")
    have = sets.of(pairs.select(F.explode(F.array("u", "v")).alias("node")))
    # Few nodes have more than one slice: written, so that the planner sees how few and joins them without a shuffle.
    hubs = pairs.groupBy(F.col("v").alias("hub")).agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices")).where("slices > 1")
    hubs = support.materialize(hubs, "hubs")
    slices = F.coalesce("slices", F.lit(1))
    dealt = pairs.join(hubs, F.col("v") == F.col("hub"), "left").select("u", "v", F.pmod(F.xxhash64("u"), slices).cast("int").alias("slice"))
    left = dealt.join(have.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    right = have.join(hubs, F.col("node") == F.col("hub"), "left")
    right = right.select(F.col("node").alias("v"), F.col("shingles").alias("b"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = [similar(np.frombuffer(a[i].as_buffer(), U64), np.frombuffer(b[i].as_buffer(), U64), percent) for i in range(len(a))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    joined = left.join(right, ["v", "slice"]).select("u", "v", "a", "b")
    links = support.materialize(joined.mapInArrow(support.lean(run), "u long, v long"), "links")
    support.discard(pairs, have, hubs)
    return links


def _blocked(members: DataFrame) -> DataFrame:
    """Each member once for every pair of the ``blocks`` of its bucket in which its own block takes part."""
    own = F.pmod(F.hash("node"), F.col("blocks"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return members.select(
        "*", own.alias("own"), F.explode(F.transform(others, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))).alias("at")
    )


def _mark(left: DataFrame, evidence: DataFrame, near: Callable, percent: int, block: int) -> DataFrame:
    """Members of ``left(key, node, root, blocks)`` that may have a link to another component in their bucket, with new ``blocks``.

    Sizes must allow it, and the function ``(x, others)`` that ``near`` makes of a block's rows of ``evidence(node, told, n)``.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        node, root, own, n = (np.asarray(rows.column(c)) for c in ("node", "root", "own", "n"))
        allowed = near(rows.column("told").to_pylist(), n)
        i, j = key[1].as_py(), key[2].as_py()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        hit = np.zeros(len(node), bool)
        for x in a:
            fits = 100 * np.minimum(n[b], n[x]) >= percent * np.maximum(n[b], n[x])
            other = b[(root[b] != root[x]) & fits]
            found = other[allowed(x, other)] if len(other) else other
            hit[found] = True
            hit[x] |= len(found) > 0
        return rows.select(["key", "node", "root", "n"]).filter(pa.array(hit))

    spread = _blocked(left.select("key", "node", "root", "blocks")).join(evidence, "node")
    flat = spread.select("key", "node", "root", "n", "own", "told", F.col("at.i").alias("i"), F.col("at.j").alias("j"))
    found = flat.groupBy("key", "i", "j").applyInArrow(run, "key long, node long, root long, n long").distinct()
    sizes = found.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(block), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    return found.drop("n").join(sizes.select("key", blocks.alias("blocks")), "key")


def _may_link(left: DataFrame, signed: DataFrame, block: int, percent: int, m: int) -> DataFrame:
    """Members whose signature comes near that of a member of another component in the same bucket.

    The margin is six standard deviations of an independent estimate below the threshold.
    """
    t = percent / 100
    least = max(0.0, t - 6 * (t * (1 - t) / m) ** 0.5)
    need = least + (1 - least) / 256

    def near(told: list[bytes], n: np.ndarray) -> Callable:
        sig = np.frombuffer(b"".join(told), np.uint8).reshape(len(told), -1)
        return lambda x, other: (sig[other] == sig[x]).mean(axis=1) >= need

    counted = left.withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    return _mark(counted, signed.select(F.col("row").alias("node"), F.col("sig").alias("told"), "n"), near, percent, block)


def parities(e: np.ndarray) -> bytes:
    """Bits of a set, each whether an odd number of its elements fall on it: at least four for an element, up to ``PARITY``.

    Two sets' bits differ in no more places than there are elements in one of the sets alone, also when the longer bits
    are folded, half upon half, to the length of the shorter ones.
    """
    size = min(PARITY, 1 << max(9, (4 * len(e) - 1).bit_length()))
    odd = np.bincount((mix(e) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(told: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Of the parities ``told``, a function ``(x, others)``: in how many places those of x differ from each of others."""
    size = np.array([len(t) for t in told])
    folded = {}
    for w in np.unique(size).tolist():
        folded[w] = np.zeros((len(told), w // 8), U64)
        for at in np.flatnonzero(size >= w).tolist():
            folded[w][at] = np.bitwise_xor.reduce(np.frombuffer(told[at], U64).reshape(-1, w // 8), axis=0)

    def run(x: int, other: np.ndarray) -> np.ndarray:
        out, least = np.zeros(len(other), np.int64), np.minimum(size[other], size[x])
        for w in np.unique(least).tolist():
            at, bits = np.flatnonzero(least == w), folded[w]
            out[at] = np.bitwise_count(bits[other[at]] ^ bits[x]).sum(axis=1, dtype=np.int64)
        return out

    return run


def _parities_allow(marked: DataFrame, have: DataFrame, block: int, percent: int) -> DataFrame:
    """The members of ``marked`` that parity bits do not rule out; no link is lost, and bits are shuffled in place of sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(1)]
            bits = pa.array([parities(e) for e in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits, pa.array([len(e) for e in sets], pa.int64())], ["node", "told", "n"])

    def near(told: list[bytes], n: np.ndarray) -> Callable:
        differ = differing(told)
        # Elements in one set alone of two that are similar enough.
        return lambda x, other: differ(x, other) * (100 + percent) <= (100 - percent) * (n[other] + n[x])

    told = have.select("node", "shingles").mapInArrow(support.lean(sketch), "node long, told binary, n long")
    return _mark(marked, told, near, percent, block)


def _link_blocks(marked: DataFrame, sets: _Texts, percent: int, block: int) -> DataFrame:
    """Verified links across components, a spanning forest for each pair of blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        node, root, own = (np.asarray(rows.column(c)) for c in ("node", "root", "own"))
        shingles = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("shingles")]
        i, j = key[1].as_py(), key[2].as_py()
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        out = []
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for x in a:
            for y in b:
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q and similar(shingles[x], shingles[y], percent):
                    up[max(p, q)] = min(p, q)
                    out.append((int(node[x]), int(node[y])))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    have = sets.of(marked.select("node"))
    close = support.materialize(_parities_allow(marked, have, block, percent), "close")
    node = F.xxhash64("node")
    spread = _blocked(close).join(support.pass_bitmap(have, node, support.bitmap(close, node)), "node")
    flat = spread.select("key", "node", "root", "own", "shingles", F.col("at.i").alias("i"), F.col("at.j").alias("j"))
    links = support.materialize(flat.groupBy("key", "i", "j").applyInArrow(run, "u long, v long").distinct(), "links")
    support.discard(have, close)
    return links
