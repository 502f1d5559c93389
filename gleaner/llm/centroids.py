"""Delta Lloyd: k-means on integer vectors, in which a round works only on what the round before changed.

A written table holds each vector's owner and squared distance; the global sums and counts of the k clusters (k
times the dimension numbers, bounded by parameters) live on the driver.  A round gets the centroids that changed
since the last one.  A vector whose owner stayed where it was is compared with the changed centroids alone, because
every other centroid lost against the owner before and neither has moved; only a vector whose owner moved is compared
with all.  Vectors that change owner send a signed transfer, minus their components to the old owner and plus to the
new one; tasks add their transfers up to k rows each before the shuffle, and the sums follow by exact integer
addition.  When no centroid moves, the assignment stands and the remaining rounds cost nothing.

Every round's assignment is a written table (the older one goes), so a lost executor re-reads one round.

Defined cases: vectors that are null, of another dimension, or with a null or non-finite component are left out.
Components beyond 2**27 in magnitude after scaling count as 2**27 - 1 of their sign, so that squared distances fit a
long; an inertia that does not fit is null.  Seeds are the vectors of smallest hash of id; a null id sorts last, and
equal hashes (repeated ids) go by components.  Fewer vectors than k give as many centroids as vectors; repeated rows
are vectors of their own, and equal centroids leave all vectors to the smaller number.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support

#: Largest magnitude of a component; 64 squared differences of twice that still fit a long.
LARGEST = (1 << 27) - 1
#: Vectors in one matrix of distances.
ROWS = 8192


def quantised(vector: Column, dim: int, scale: int) -> Column:
    """``floor(scale * x)`` of every component, null unless there are ``dim`` finite ones."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * scale))).cast("int"))
    return F.when((F.size(x) == dim) & finite, whole)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest hash of ``salt:id``; a top-k, so tasks send ``k`` rows each."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    least = vectors.select(order.alias("hash"), "q").orderBy(F.col("hash").asc_nulls_last(), "q").limit(k)
    return np.array([r.q for r in least.collect()], np.int64)


def nearest(x: np.ndarray, owner: np.ndarray, best: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance of each row of ``x`` after the ``changed`` centroids moved; owner -1 has none yet."""
    everything = np.arange(len(centroids))
    moved = (owner < 0) | np.isin(owner, changed)
    owner, best = owner.copy(), best.copy()
    for rows, against in ((np.flatnonzero(moved), everything), (np.flatnonzero(~moved), changed)):
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            if not len(against):
                break
            far = np.stack([np.square(x[part] - centroids[c]).sum(axis=1) for c in against], axis=1)
            i = far.argmin(axis=1)
            d, c = far[np.arange(len(part)), i], against[i]
            if against is changed:
                stays = (best[part] < d) | ((best[part] == d) & (owner[part] < c))
                d, c = np.where(stays, best[part], d), np.where(stays, owner[part], c)
            best[part], owner[part] = d, c
    return owner, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state: ``vec_id, q, cluster, distance`` and ``previous``, the owner before."""
    dim, schema = centroids.shape[1], state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, best = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            new, far = nearest(_matrix(batch.column(1), dim), owner, best, centroids, changed)
            columns = [batch.column(0), batch.column(1), pa.array(new, pa.int32()), pa.array(far, pa.int64()), pa.array(owner, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return state.mapInArrow(support.lean(run), schema)


def transfers(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed changes of the clusters' sums and counts by the vectors that changed owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            new, old = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            np.add.at(total, new, x)
            np.subtract.at(total, old[old >= 0], x[old >= 0])
        some = np.flatnonzero(total.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "delta"])

    sent = state.where("cluster <> previous").select("q", "cluster", "previous").mapInArrow(support.lean(run), "cluster int, delta array<bigint>")
    each = sent.groupBy("cluster").agg(F.array(*[F.sum(F.get("delta", F.lit(i))) for i in range(dim + 1)]).alias("delta"))
    out = np.zeros((k, dim + 1), np.int64)
    for r in each.collect():  # k rows
        out[r.cluster] = r.delta
    return out[:, :dim], out[:, dim]


def delta_lloyd(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, salt: str = "1"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector after ``rounds`` updates and a last assignment."""
    kept = table.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), dim, scale).alias("q")).where("q is not null")
    none = F.lit(-1)
    state = support.materialize(kept.select("vec_id", "q", none.alias("cluster"), none.cast("long").alias("distance"), none.alias("previous")), "vectors")
    centroids = seeds(state, k, salt)
    if not len(centroids):
        return _result(state, centroids.reshape(0, dim))
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    changed = np.arange(len(centroids))
    for step in range(rounds + 1):
        old, state = state, support.materialize(assign(state, centroids, changed), "owners")
        support.discard(old)
        if step == rounds:
            break
        plus, n = transfers(state, len(centroids), dim)
        sums, counts = sums + plus, counts + n
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        changed, centroids = np.flatnonzero((moved != centroids).any(axis=1)), moved
        if not len(changed):  # nothing can change any more
            break
    return _result(state, centroids)


def _result(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = state.sparkSession
    digest = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digest, "cluster int, centroid_sha256 string")
    each = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    total = each.agg(F.sum("part").alias("whole"))
    # One row a cluster: k rows, whatever the table has.
    stats = each.join(named, "cluster").crossJoin(F.broadcast(total))
    fit = lambda c: F.col(c).try_cast("bigint")
    return state.join(F.broadcast(stats), "cluster").select(
        "vec_id", "cluster", "distance", fit("part").alias("cluster_inertia"), fit("whole").alias("inertia"), "centroid_sha256"
    )
