"""An inverted-file index of vectors: cells around centroids, read only where a question's neighbours are likely.

Centroids are fitted on a bounded sample (``sample`` vectors of smallest hash of position); every vector is then
assigned to its nearest one.  Vectors of a cell are packed into blocks of at most ``BLOCK`` rows, one matrix a block, so
a cell that holds a third of all vectors is many rows and never one group; blocks are dealt and sorted by cell.

A search probes the cells nearest to each question.  Questions meet the blocks in an equi-join on the cell, gathered in
chunks of at most ``CHUNK`` a cell; a block sends the best k of each question, so what is shuffled does not grow with
the cells.  Scores are cosines in double precision, those of the exact path (``ranking.dense``).  How many cells are
probed is fitted too: the fewest for which the sample's own neighbours would be found at the rate that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import ranking
from gleaner.session import checkpointed, spread
from gleaner.sources.corpus import POSITION

SAMPLE, CELLS, BLOCK, CHUNK = 20_000, 4096, 1024, 256
#: Rows of best vectors that a task of a full scan holds before it sends them.
HELD = 1_000_000
#: Cells that hold too few vectors cost more than they save.
LEAST_CELL = 24


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty cell keeps its centroid."""
    middle = x[np.random.default_rng(7).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ middle.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(middle)
        np.add.at(total, own, x)
        some = np.linalg.norm(total, axis=1) > 0
        moved = middle.copy()
        moved[some] = _unit(total[some])
        if np.allclose(moved, middle):
            break
        middle = moved
    return middle


def fit_probes(x: np.ndarray, middle: np.ndarray, k: int, recall: float, asked: int = 400) -> int:
    """The fewest cells a question must probe so that ``recall`` of the sample's ``k`` nearest are met."""
    own = (x @ middle.T).argmax(axis=1)
    some = x[:: max(1, len(x) // asked)]
    near = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(some @ middle.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(middle))[None, :].repeat(len(some), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """``blocks(cell, block, pos, matrix)`` on storage and one row ``cells(centroids, dim, probes)``."""

    blocks: DataFrame
    cells: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/cells"))


def _usable(column: Column) -> Column:
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v))


def write_vectors(vectors: DataFrame, path: str, *, sample: int = SAMPLE, cells: int | None = None, k: int = 10, recall: float = 0.95) -> VectorIndex:
    """Index ``(_pos, embedding)`` under ``path``; vectors that are null or hold a null are left out, as no cosine is defined for them."""
    spark = vectors.sparkSession
    rows = spread(vectors.select(POSITION, F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding"))))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64(POSITION), POSITION).limit(sample).select("embedding").toArrow().column(0).combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    if len(set(np.diff(drawn.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length: they come from different embedding models")
    x = _unit(_matrix(drawn))
    count = cells or max(1, min(CELLS, int(n**0.5), len(x) // LEAST_CELL))
    middle = fit_cells(x, count) if n else np.zeros((1, 0))
    probes = fit_probes(x, middle, k, recall) if n else 1
    dim = middle.shape[1]
    shared = spark.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if set(np.diff(batch.column(1).offsets.to_numpy())) - {dim}:
                raise ValueError("vectors differ in length: they come from different embedding models")
            own = (_unit(_matrix(batch.column(1))) @ shared.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], [POSITION, "embedding", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.Table) -> pa.RecordBatch:
            pos, cell = part.column(POSITION).to_numpy(), part.column("cell")[0].as_py()
            data = _matrix(part.column("embedding").combine_chunks()).astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([int(pos[0])]), pa.array([pos], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["cell", "block", "pos", "matrix"])

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            cell = held.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                last = b == len(cell)
                while b - a >= BLOCK or (a < b and not last):
                    yield block(held.slice(a, min(BLOCK, b - a)))
                    a = min(a + BLOCK, b)
                if last:
                    held = held.slice(a)
        if held is not None and held.num_rows:
            yield block(held)

    placed = rows.mapInArrow(assign, f"{POSITION} long, embedding array<double>, cell int")
    # By cell and place, so that a hot cell is cut into several ranges.
    dealt = checkpointed(placed).repartitionByRange("cell", POSITION).sortWithinPartitions("cell", POSITION)
    dealt.mapInArrow(pack, "cell int, block long, pos array<long>, matrix binary").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    told = [(middle.astype("<f8").tobytes(), dim, probes)]
    spark.createDataFrame(told, "centroids binary, dim int, probes int").write.mode("overwrite").parquet(f"{path}/cells")
    return VectorIndex.load(spark, path)


def nearest(index: VectorIndex, asked: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
    """``(qid, _pos, score, rank)``: the best ``k`` of each question ``(qid, embedding)`` in the cells that it probes, positive cosines only."""
    spark = asked.sparkSession
    cells = index.cells.first()
    dim, count = cells.dim, probes or cells.probes
    middle = np.frombuffer(cells.centroids, "<f8").reshape(-1, dim) if dim else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(middle)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if set(np.diff(batch.column(1).offsets.to_numpy())) - {dim} and dim:
                raise ValueError("query and document vectors differ in length: they come from different embedding models")
            if not dim:
                continue
            x = _matrix(batch.column(1))
            near = np.argsort(-(_unit(x) @ shared.value.T), axis=1, kind="stable")[:, :count]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(near.ravel(), pa.int32())], ["qid", "embedding", "cell"])

    questions = asked.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding")))
    met = questions.mapInArrow(probe, "qid long, embedding array<double>, cell int")
    sized = met.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("qid"), F.col("chunks")).alias("chunk")
    gathered = met.join(sized, "cell").groupBy("cell", chunk).agg(F.collect_list(F.struct("qid", "embedding")).alias("qs"))
    gathered = checkpointed(gathered.select("cell", F.col("qs.qid").alias("qids"), F.flatten(F.col("qs.embedding")).alias("asked")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qid, at, told = [], [], []
            for i in range(len(batch)):
                pos = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
                rows = _unit(np.frombuffer(batch.column(1)[i].as_buffer(), "<f8").reshape(len(pos), dim))
                ids = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                cos = _unit(batch.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), dim)) @ rows.T
                for q, line in zip(ids, cos, strict=True):
                    best = np.lexsort((pos, -line.round(9)))[:k]
                    best = best[line[best] > 0]
                    qid += [q] * len(best)
                    at += pos[best].tolist()
                    told += line[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(at, pa.int64()), pa.array(told, pa.float64())], ["qid", POSITION, "score"])

    joined = index.blocks.join(gathered, "cell").select("pos", "matrix", "qids", "asked")
    return ranking.top_k(joined.mapInArrow(score, f"qid long, {POSITION} long, score double"), k)


def exact(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(qid, _pos, score, rank)``: the best ``k`` of all vectors for each question ``(qid, embedding)``, positive cosines only.

    Every vector meets every question, as a matrix of up to ``BLOCK`` vectors and one of up to ``4 * CHUNK`` questions.  A
    task holds the best k of the questions that it has met and sends them once, so little is shuffled; what it holds
    goes out early when it is more than ``HELD`` rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(batch.column(1).is_valid())
            sizes = rows.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                some = rows.filter(pa.array(sizes == dim))
                for i in range(0, len(some), BLOCK):
                    part = some.slice(i, BLOCK)
                    data = _unit(_matrix(part.column(1))).astype("<f8").tobytes()
                    pos = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([pos, pa.array([int(dim)], pa.int32()), pa.array([data], pa.binary())], ["pos", "dim", "matrix"])

    wide = lambda df, id_: df.select(F.col(id_).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding")))
    blocks = spread(wide(vectors, POSITION)).mapInArrow(packed, "pos array<long>, dim int, matrix binary")
    questions = wide(asked, "qid")
    chunks = -(-questions.count() // (4 * CHUNK)) or 1
    told = questions.groupBy(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.size("embedding").alias("size"))
    told = told.agg(F.collect_list(F.struct("id", "embedding")).alias("qs"))
    told = checkpointed(told.select("size", F.col("qs.id").alias("qids"), F.flatten("qs.embedding").alias("asked")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for ids, at, pos, cos in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(pos), pa.array(cos)], ["qid", POSITION, "score"])
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                pos = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
                dim, ids = batch.column(1)[i].as_py(), batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                if batch.column(3)[i].as_py() != dim:
                    raise ValueError("query and document vectors differ in length: they come from different embedding models")
                rows = np.frombuffer(batch.column(2)[i].as_buffer(), "<f8").reshape(-1, dim)
                cos = _unit(batch.column(5)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)) @ rows.T
                key = (len(ids), int(ids[0]))
                held[key] = ids, *ranking.best_of(held.get(key, (ids, *ranking.NONE_HELD))[1:], cos, pos, k)
            if sum(len(h[1]) for h in held.values()) > HELD:
                yield from send()
        yield from send()

    return ranking.top_k(blocks.crossJoin(told).mapInArrow(score, f"qid long, {POSITION} long, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid, n, hit``: of each question's exact best, how many there are and how many were found."""
    got = found.select("qid", POSITION, F.lit(1).alias("met"))
    return exact.select("qid", POSITION).join(got, ["qid", POSITION], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("met").alias("hit"))
