"""Results of models kept by content: nothing is asked twice, and a broken job goes on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner import models
from gleaner.results import Results


def _counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(batch):
        calls.add(len(batch))
        return [t.upper() for t in batch]

    return calls, call


def test_only_new_inputs_are_asked(spark, tmp_path):
    calls, call = _counting(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string").repartition(3)
    kept = Results(spark, f"file://{tmp_path}/r", "model: 1/x", "string")
    kept.fill(first, "text", call, waves=3)
    assert calls.value == 3
    more = first.unionByName(spark.createDataFrame([(6, "c"), (7, "b")], "id long, text string"))
    kept.fill(more, "text", call, run="again")
    assert calls.value == 4 and kept.rows().where("run = 'again'").count() == 1
    kept.fill(more, "text", call)
    assert calls.value == 4
    got = {r.id: r.said for r in kept.joined(more, "text", "said").collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: None, 5: "", 6: "C", 7: "B"}
    other = Results(spark, f"file://{tmp_path}/r", "model: 2", "string")
    assert other.known().count() == 0 and {r.said for r in other.joined(first, "text", "said").collect()} == {None}


def test_a_broken_run_keeps_its_waves(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, text string")
    kept = Results(spark, f"file://{tmp_path}/r", "m", "array<float>")

    def fails(batch):
        if "t7" in batch:
            raise RuntimeError("the endpoint is gone")
        return [[1.0]] * len(batch)

    with pytest.raises(Exception, match="endpoint is gone"):
        kept.fill(texts, "text", fails, waves=5)
    calls = spark.sparkContext.accumulator(0)

    def works(batch):
        calls.add(len(batch))
        return [[2.0]] * len(batch)

    done = kept.rows().count()
    kept.fill(texts, "text", works, waves=5)
    assert calls.value == 40 - done and kept.known().count() == 40
    assert kept.rows().where("value[0] = 1").count() == done


def test_readers_take_one_row_of_a_key_filled_twice(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    kept = Results(spark, f"file://{tmp_path}/r", "m", "string")
    kept.fill(texts, "text", lambda batch: ["x"] * len(batch))
    kept.rows().write.mode("append").parquet(kept.path)
    assert kept.rows().count() == 2 and kept.joined(texts, "text", "said").count() == 1


def test_wrong_number_of_results(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="gave 0 results for 1"):
        Results(spark, f"file://{tmp_path}/r", "m", "string").fill(texts, "text", lambda batch: [])


def test_embed_once_and_map_llm(spark, tmp_path):
    texts = spark.createDataFrame([(0, "one two"), (1, None), (2, "one two"), (3, "three")], "_pos long, text string")
    calls, call = _counting(spark)
    embedder = models.hashed_words(16)

    def counted(batch):
        calls.add(len(batch))
        return embedder(batch)

    for _ in range(2):
        got = {r["_pos"]: r.embedding for r in models.embed_once(texts, f"file://{tmp_path}/v", "hashed", counted).collect()}
    want = {r["_pos"]: r.embedding for r in models.embed(texts.where("text is not null"), embedder).collect()}
    assert got == want | {1: None} and calls.value == 2
    asked = texts.select(F.col("_pos").alias("qid"), F.col("text").alias("prompt"))
    replies = {r.qid: r.reply for r in models.map_llm(asked, lambda p: p + "!", path=f"file://{tmp_path}/l", label="m", waves=2).collect()}
    assert replies == {0: "one two!", 1: None, 2: "one two!", 3: "three!"}
    assert {r.reply for r in models.map_llm(asked.where("prompt is not null"), lambda p: p + "?").collect()} == {"one two?", "three?"}


def test_a_text_that_is_not_read_is_not_shuffled(spark, tmp_path):
    kept = Results(spark, f"file://{tmp_path}/r", "m", "int")
    texts = spark.createDataFrame([(1, "a"), (2, None)], "_pos long, text string").repartition(2)
    kept.fill(texts, "text", lambda batch: [len(t) for t in batch])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        node = kept.joined(texts, "text", "n").select("_pos", "n")._jdf.queryExecution().optimizedPlan()
        while node.children().size() == 1:
            node = node.children().head()
        assert "text" not in node.children().head().output().mkString(",")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r._pos, r.n) for r in kept.joined(texts, "text", "n").collect()) == [(1, 1), (2, None)]
