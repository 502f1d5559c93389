"""The inverted-file index: all cells give the exact answers, few cells give most of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import ranking, vectors
from gleaner.sources.corpus import POSITION

SCHEMA = f"{POSITION} long, embedding array<float>"


def _rows(seed=1, n=600, dim=8, hot=150):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, dim))
    x = middles[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dim))
    x[:hot] = x[0]  # one very common vector
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [None] * dim), (n + 3, [])]


def _key(r):
    return r.qid, r["rank"], r[POSITION], round(r.score, 6)


def test_all_cells_are_exact_and_some_find_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "CHUNK", 4)
    table = spark.createDataFrame(_rows(), SCHEMA).repartition(4)
    index = vectors.write_vectors(table, f"file://{tmp_path}/v", sample=300)
    asked = table.where(F.col(POSITION) % 40 == 0).where("size(embedding) = 8").select(F.col(POSITION).alias("qid"), "embedding")
    exact = ranking.top_k(ranking.dense(table.where("size(embedding) = 8 and embedding[0] is not null"), asked), 10)
    whole = vectors.nearest(index, asked, 10, probes=10_000)
    assert sorted(map(_key, whole.collect())) == sorted(map(_key, exact.collect()))
    told = vectors.recall(vectors.nearest(index, asked, 10), exact).agg(F.sum("hit"), F.sum("n")).first()
    assert told[0] >= 0.9 * told[1]
    blocks = index.blocks.select("cell", F.size("pos").alias("n")).collect()
    assert max(b.n for b in blocks) <= 32 and sum(b.n for b in blocks) == 601
    assert len({b.cell for b in blocks}) > 3 and 1 <= index.cells.first().probes < 12


def test_no_vectors_and_one(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], SCHEMA)
    asked = spark.createDataFrame([(5, [1.0, 2.0])], "qid long, embedding array<float>")
    assert vectors.nearest(vectors.write_vectors(none, f"file://{tmp_path}/a"), asked, 3).collect() == []
    one = vectors.write_vectors(spark.createDataFrame([(9, [2.0, 4.0]), (8, [-1.0, 0.0])], SCHEMA), f"file://{tmp_path}/b")
    assert [(r.qid, r[POSITION], round(r.score, 6)) for r in vectors.nearest(one, asked, 3).collect()] == [(5, 9, 1.0)]


def test_vectors_of_another_length(spark, tmp_path):
    index = vectors.write_vectors(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA), f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="differ in length"):
        vectors.nearest(index, spark.createDataFrame([(5, [1.0])], "qid long, embedding array<float>"), 3).collect()
    with pytest.raises(Exception, match="differ in length"):
        vectors.write_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], SCHEMA), f"file://{tmp_path}/b")


def test_the_full_scan_in_matrices_gives_the_exact_best(spark, monkeypatch):
    """Ties by position, questions in several chunks, blocks smaller than a batch, held rows sent early: as in ``ranking.dense``."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "CHUNK", 4)
    monkeypatch.setattr(vectors, "HELD", 50)
    table = spark.createDataFrame(_rows(seed=4), SCHEMA).repartition(3)
    asked = table.where(F.col(POSITION) % 20 == 0).where("size(embedding) = 8").select(F.col(POSITION).alias("qid"), "embedding")
    want = ranking.top_k(ranking.dense(table.where("size(embedding) = 8 and embedding[0] is not null"), asked), 10)
    assert sorted(map(_key, vectors.exact(table, asked, 10).collect())) == sorted(map(_key, want.collect()))
    with pytest.raises(Exception, match="differ in length"):
        vectors.exact(table, spark.createDataFrame([(1, [1.0])], "qid long, embedding array<float>"), 3).collect()
