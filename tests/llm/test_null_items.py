"""Benchmark items without an id still contaminate."""

from __future__ import annotations

from gleaner.llm import decontaminate


def test_items_without_id_count_as_hits_but_not_as_names(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, "x " + passage + " short one"), (3, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "short one"), (7, "short one")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (20, 0, True), 2: (22, 1, True), 3: (0, 0, False)}
