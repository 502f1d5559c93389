"""Best-fit packing of token sequences.

``pack_matrices`` tokenises, splits overlong documents and packs each task's documents by best-fit-decreasing
into id matrices, with cumulative segment lengths and position resets, without any shuffle.

``pack_hierarchically`` packs pieces by their lengths over the whole table: each task packs its own pieces
best-fit and emits the nearly full bins; the pieces of underfull bins go on as items, merged tree-wise, eight
nodes into one, with best-fit again at each node, up to a root that emits everything.  Above the tasks only
counts by length move (at most ``capacity`` numbers a node), because pieces of one length are
interchangeable: a node decides for ranges of ordinals, and each piece finds its place by its ordinal.  So no
node, not even the root, ever holds the pieces themselves, however many are left.  With ``whole_bins`` the items
that go on are the closed bins, counted by their fill, and a piece also keeps its place inside its bin.

Both use the same best-fit-decreasing search: bins of equal residual capacity stand together, and a segment
tree over residuals finds the smallest one that takes the next length.

Defined cases: a null or empty text is a document of the end token alone; repeated rows are packed each;
null ids are passed through; an empty table gives no sequences.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support, tokens
from gleaner.llm.words import slices

END = 2
FAN_IN = 8


class Residuals:
    """Segment tree over residual capacities 0..capacity: where bins are, and the smallest residual >= x."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, there: bool) -> None:
        at += self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            now = self.any[2 * at] | self.any[2 * at + 1]
            if self.any[at] == now:
                return
            self.any[at] = now

    def first(self, least: int) -> int | None:
        """The smallest residual that is at least ``least`` and has bins."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """Best-fit-decreasing of ``counts[length]`` pieces: groups ``(bins, residual, ((length, times), ...))``.

    Bins with equal contents stay one group, so the work depends on the distinct lengths, not on the pieces.
    """
    tree, stacks = Residuals(capacity), {}

    def put(n: int, residual: int, what: tuple) -> None:
        stacks.setdefault(residual, []).append((n, what))
        tree.set(residual, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            residual = tree.first(length)
            if residual is None:
                n, what, room = left, (), capacity
            else:
                n, what = stacks[residual].pop()
                if not stacks[residual]:
                    tree.set(residual, False)
                room = residual
            each = min(room // length, left)
            full = min(n, left // each)
            if n > full and residual is not None:
                put(n - full, room, what)
            put(full, room - each * length, (*what, (length, each)))
            left -= full * each
    return [(n, residual, what) for residual, stack in stacks.items() for n, what in stack]


def placed(groups: Sequence[tuple], spare: int, capacity: int, whole_bins: bool = False) -> tuple[list[tuple[int, ...]], dict[int, int], int, dict[int, int]]:
    """Ranges ``(size, ordinal, n, bin, offset, fill, first)`` of the items of the groups, items used by size, bins emitted, closed bins by fill.

    Groups with residual up to ``spare`` are emitted.  Of the others, whole bins become items of their fill, with
    ordinals from ``first`` and ``bin`` -1, or else their items are left as they were.
    """
    rows, used, bins, closed = [], {}, 0, {}
    for n, residual, what in groups:
        if residual > spare and not whole_bins:
            continue
        emitted, fill, offset = residual <= spare, capacity - residual, 0
        for size, times in what:
            for _ in range(times):
                rows.append((size, used.get(size, 0), n, bins if emitted else -1, offset, fill, closed.get(fill, 0)))
                used[size] = used.get(size, 0) + n
                offset += size
        if emitted:
            bins += n
        else:
            closed[fill] = closed.get(fill, 0) + n
    return rows, used, bins, closed


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document with ``n`` ids; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [*([(0, first)] if first else []), *((s, capacity) for s in range(first, n, capacity))]


def _documents(batch: pa.RecordBatch, vocabulary: str, end: int) -> Iterator[tuple[object, np.ndarray]]:
    encode = tokens.encoder(vocabulary)
    texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
    for a, b in slices(texts):
        yield from zip(ids[a:b], encode.ids(texts[a:b], end), strict=True)


def pack_matrices(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = END, pad: int = 0,
    vocabulary: str | None = None, buffer_tokens: int = 1 << 22,
) -> DataFrame:
    """One row per packed sequence of at most ``capacity`` tokens.

    ``doc_ids, pieces, starts`` name its segments; ``cu_seqlens`` has their cumulative lengths from 0;
    ``resets`` the places where positions start again at 0; ``ids`` one matrix row of ``capacity`` ids padded
    with ``pad``, little-endian in ``id_bytes`` bytes each.  A task packs its documents in buffers of about
    ``buffer_tokens`` tokens, which bounds its memory.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    kind = support.type_of(docs, id_col)
    id_type = docs.select(F.col(id_col).alias("doc_id")).limit(0).toArrow().schema.field(0).type
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def flush(buffer: list[tuple], first: int) -> pa.RecordBatch:
        by_length: dict[int, list[int]] = {}
        for i, (_, _, _, ids) in enumerate(buffer):
            by_length.setdefault(len(ids), []).append(i)
        bins: list[list[int]] = []
        for n, _, what in best_fit({k: len(v) for k, v in by_length.items()}, capacity):
            for _ in range(n):
                bins.append([by_length[length].pop() for length, times in what for _ in range(times)])
        cu = [np.concatenate([[0], np.cumsum([len(buffer[i][3]) for i in b])]).astype(np.int32) for b in bins]
        matrix = np.full((len(bins), capacity), pad, buffer[0][3].dtype)
        for row, b in zip(matrix, bins, strict=True):
            ids = np.concatenate([buffer[i][3] for i in b])
            row[: len(ids)] = ids
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(bins)), pa.int64()),
                pa.array([[buffer[i][0] for i in b] for b in bins], pa.list_(id_type)),
                pa.array([[buffer[i][1] for i in b] for b in bins], pa.list_(pa.int32())),
                pa.array([[buffer[i][2] for i in b] for b in bins], pa.list_(pa.int64())),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
                pa.array([int(c[-1]) for c in cu], pa.int64()),
                pa.array([matrix.itemsize] * len(bins), pa.int32()),
                pa.array([r.astype(r.dtype.newbyteorder("<")).tobytes() for r in matrix], pa.binary()),
            ],
            ["sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "resets", "n_tokens", "id_bytes", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, buffer, held = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc, ids in _documents(batch, vocabulary, end):
                for i, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                    buffer.append((doc, i, start, ids[start : start + n]))
                    held += n
                if held >= buffer_tokens:
                    out = flush(buffer, first)
                    first, buffer, held = first + out.num_rows, [], 0
                    yield out
        if buffer:
            yield flush(buffer, first)

    fields = "pieces array<int>, starts array<long>, cu_seqlens array<int>, resets array<int>, n_tokens long, id_bytes int, ids binary"
    return base.mapInArrow(support.lean(run), f"sequence_id long, doc_ids array<{kind}>, {fields}")


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet: one id matrix row a record, its segment bounds, resets and the position of each token."""
    positions = F.expr("flatten(transform(resets, (r, i) -> transform(sequence(1, cu_seqlens[i + 1] - r), x -> x - 1)))")
    packed.withColumn("position_ids", positions).write.option("compression", "zstd").parquet(path)


def pack_hierarchically(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = END,
    vocabulary: str | None = None, spare: int | None = None, buffer_pieces: int = 1 << 18, whole_bins: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    With ``whole_bins`` an underfull bin goes up closed, as one item of its fill; without, its pieces go up by
    themselves, which packs tighter.

    ``spare`` is the residual up to which a bin counts as nearly full below the root (1/256 of capacity).  A task
    packs ``buffer_pieces`` at a time, which bounds its memory.
    """
    spare = capacity // 256 if spare is None else spare
    vocabulary = vocabulary or tokens.default_vocabulary()
    kind = support.type_of(docs, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces with their places in nearly full bins, or else the ordinal among the task's pieces of that length that go on."""
        part, bins, waiting = TaskContext.get().partitionId(), 0, Counter()

        def flush() -> pa.RecordBatch:
            nonlocal bins
            length = np.array(cols[2], np.int64)
            by_length = {int(n): np.flatnonzero(length == n) for n in np.unique(length)}
            rows, used, made, closed = placed(best_fit({n: len(at) for n, at in by_length.items()}, capacity), spare, capacity, whole_bins)
            place = np.stack([np.full(len(length), -1), np.zeros(len(length), np.int64), length, np.full(len(length), -1)])  # bin, offset, size, ordinal
            for n, ordinal, times, bin_, offset, fill, first in rows:
                at, each = by_length[n][ordinal : ordinal + times], np.arange(times)
                place[1, at] = offset
                if bin_ >= 0:
                    place[0, at] = bins + bin_ + each
                else:
                    place[2, at], place[3, at] = fill, waiting[fill] + first + each
            for n, at in by_length.items():
                rest = at[used.get(n, 0) :]
                place[3, rest] = waiting[n] + np.arange(len(rest))
                waiting[n] += len(rest)
            waiting.update(closed)
            bins += made
            whole = [pa.array(ids_, kind_), *(pa.array(c, pa.int64()) for c in cols), pa.array(np.full(len(length), part), pa.int64()), *map(pa.array, place)]
            return pa.RecordBatch.from_arrays(whole, names)

        ids_, cols, kind_ = [], [[] for _ in range(4)], None
        for batch in batches:
            kind_ = batch.schema.field(0).type
            for doc, ids in _documents(batch, vocabulary, end):
                for i, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                    ids_.append(doc)
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    for col, x in zip(cols, (i, start, n, crc), strict=True):
                        col.append(x)
                if len(ids_) >= buffer_pieces:
                    table = flush()
                    ids_, cols = [], [[] for _ in range(4)]
                    yield from (table.slice(i, 50_000) for i in range(0, table.num_rows, 50_000))
        if ids_:
            table = flush()
            yield from (table.slice(i, 50_000) for i in range(0, table.num_rows, 50_000))

    names = ["doc_id", "piece", "start", "length", "crc", "node", "bin", "offset", "size", "ordinal"]
    schema = ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:])])
    now = support.materialize(base.mapInArrow(support.lean(local), schema), "pieces")
    number = lambda level: F.lit(level << 60) + F.shiftleft("node", 32) + F.col("bin")
    now = now.withColumn("sequence_id", F.when(F.col("bin") >= 0, number(0)))
    waiting = now.where("bin < 0 and offset = 0")  # the first piece of each item
    counts = support.materialize(waiting.groupBy("node", "size").agg(F.count("*").alias("n")), "counts")
    top, level = counts.agg(F.max("node")).first()[0], 0
    while top is not None:
        level += 1
        root = top < FAN_IN
        decided = support.materialize(_decide(counts, capacity, capacity if root else spare, whole_bins), "decided")
        step = decided.select(F.col("child").alias("node"), "size", F.col("before"), F.col("used"), "cuts")
        joined = now.join(step, ["node", "size"], "left")
        at = F.col("ordinal") + F.col("before")
        mine = F.col("sequence_id").isNull()
        cut = F.filter("cuts", lambda c: (c.ordinal <= F.col("at")) & (F.col("at") < c.ordinal + c.n))
        joined = joined.withColumn("at", at).withColumn("cut", F.when(mine & (F.col("at") < F.col("used")), F.get(cut, F.lit(0))))
        up, each, emitted = F.shiftrightunsigned("node", 3), F.col("at") - F.col("cut.ordinal"), F.col("cut.bin") >= 0
        closed = F.col("cut.bin") < 0
        now = joined.select(
            *names[:5],
            F.when(mine, up).otherwise(F.col("node")).alias("node"),
            F.when(emitted, F.col("cut.bin") + each).otherwise(F.col("bin")).alias("bin"),
            F.when(F.col("cut").isNotNull(), F.col("cut.offset") + F.col("offset")).otherwise(F.col("offset")).alias("offset"),
            F.when(closed, F.col("cut.fill")).otherwise(F.col("size")).alias("size"),
            F.when(closed, F.col("cut.first") + each).when(mine, F.col("at") - F.col("used")).otherwise(F.col("ordinal")).alias("ordinal"),
            F.when(emitted, F.lit(level << 60) + F.shiftleft(up, 32) + F.col("cut.bin") + each).otherwise(F.col("sequence_id")).alias("sequence_id"),
        )
        if root:
            break
        counts = decided.where("rest > 0").groupBy(F.col("up").alias("node"), "size").agg(F.sum("rest").alias("n"))
        counts = support.materialize(counts, "counts")
        top = counts.agg(F.max("node")).first()[0]
    return now.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def _decide(counts: DataFrame, capacity: int, spare: int, whole_bins: bool) -> DataFrame:
    """Best-fit at each node one level up, from its children's counts by size.

    Per child and size: the ordinals ``before`` it at the node, how many the node has ``used``, the ``cuts`` of
    ordinals into bins, and on one child the ``rest`` that goes up.  Closed bins that go up have rows without a child.
    """

    def run(node: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "child"])
        sizes = rows["size"]
        total = rows.groupby("size")["n"].sum()
        ranges, used, _, closed = placed(best_fit({int(k): int(v) for k, v in total.items()}, capacity), spare, capacity, whole_bins)
        cuts: dict[int, list] = {}
        for size, ordinal, n, bin_, offset, fill, first in ranges:
            cuts.setdefault(size, []).append({"ordinal": ordinal, "n": n, "bin": bin_, "offset": offset, "fill": fill, "first": first})
        spent = [used.get(k, 0) for k in sizes.tolist()]
        fresh = ~sizes.duplicated()
        rest = [int(total[k]) - u if f else 0 for k, u, f in zip(sizes.tolist(), spent, fresh, strict=True)]
        told = {"child": rows["child"], "size": sizes, "before": rows.groupby("size")["n"].cumsum() - rows["n"], "used": spent, "cuts": [cuts.get(k, []) for k in sizes.tolist()], "rest": rest}
        made = pd.DataFrame(told | {"up": node[0]})
        bins = pd.DataFrame([{"child": None, "size": k, "before": 0, "used": 0, "cuts": [], "rest": n, "up": node[0]} for k, n in closed.items()])
        return pd.concat([made.astype({"child": object}), bins])[fields] if closed else made[fields]

    grouped = counts.select(F.shiftrightunsigned("node", 3).alias("up"), F.col("node").alias("child"), "size", "n").groupBy("up")
    fields = ["up", "child", "size", "before", "used", "cuts", "rest"]
    cut = "struct<ordinal: long, n: long, bin: long, offset: long, fill: long, first: long>"
    return grouped.applyInPandas(run, f"up long, child long, size long, before long, used long, cuts array<{cut}>, rest long")
