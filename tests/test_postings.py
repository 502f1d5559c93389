"""Block-max postings: the best k equal the full scores, whatever the blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import postings, ranking
from gleaner.sources.corpus import POSITION


def _texts(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.expovariate(0.05))}" for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(int(r.expovariate(0.03))))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "w1 " * 500), (n + 3, "W1, w1. w2"), *((n + 4 + i, "w1 w2 w3") for i in range(30))]


def _same(found, index, asked, k):
    key = lambda r: (r.qid, r["rank"], r[POSITION], round(r.score, 6))
    want = ranking.top_k(ranking.bm25(index, asked), k).collect()
    assert sorted(map(key, found.top.collect())) == sorted(map(key, want))


@pytest.mark.parametrize("width,frequent,first,k", [(16, 20, 1, 5), (64, 1, 3, 10), (512, 10**9, 8, 7), (7, 40, 2, 1000)])
def test_best_equal_full_scores(spark, tmp_path, width, frequent, first, k):
    texts = spark.createDataFrame(_texts(width), f"{POSITION} long, text string").repartition(3)
    index = postings.write_blocks(texts, f"file://{tmp_path}/index", width=width, frequent=frequent)
    asked = ranking.questions(spark, ["w1 w2 w3 w1", "w0", "w40 w1", "unknown", "", "w60 w70 w5 w5 w2", "w1"])
    _same(postings.best(index, asked, k, first=first), ranking.build_index(texts), asked, k)
    whole = {(r[POSITION], r.term): (r.tf, r.len) for r in ranking.build_index(texts).tf.collect()}
    assert {(r[POSITION], r.term): (r.tf, r.len) for r in index.postings().tf.collect()} == whole


def test_blocks_are_skipped_and_counted(spark, tmp_path):
    """Long documents cannot beat the short ones that repeat a word, so their windows stay closed."""
    r = random.Random(6)
    docs = [(i, "hit hit hit " if i % 50 == 0 else "hit " + " ".join(f"x{r.randrange(999)}" for _ in range(60 + i % 40))) for i in range(2000)]
    texts = spark.createDataFrame(docs, f"{POSITION} long, text string").repartition(4)
    index = postings.write_blocks(texts, f"file://{tmp_path}/index", width=64, frequent=100)
    asked = ranking.questions(spark, ["hit"])
    found = postings.best(index, asked, 10)
    _same(found, ranking.build_index(texts), asked, 10)
    told = found.read.first()
    assert told.read < told.blocks / 4
    assert index.blocks.where("frequent").agg(F.max("n")).first()[0] <= 64


def test_an_empty_corpus(spark, tmp_path):
    texts = spark.createDataFrame([], f"{POSITION} long, text string")
    index = postings.write_blocks(texts, f"file://{tmp_path}/index")
    assert postings.best(index, ranking.questions(spark, ["any"]), 3).top.collect() == []
