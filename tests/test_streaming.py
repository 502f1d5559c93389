from datetime import datetime

from gleaner.operators import ranking
from gleaner.sources.corpus import POSITION
from gleaner.streaming import index, windows


def test_incremental_index_equals_the_batch_one(spark, tmp_path):
    docs = [(i, f"word{i % 3} common text {i}") for i in range(12)]
    schema = f"{POSITION} long, text string"
    spark.createDataFrame(docs[:6], schema).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame(docs[6:], schema).write.parquet(str(tmp_path / "in/b"))
    for folder in ("a", "b"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")) if folder == "b" else spark.readStream.schema(schema).parquet(str(tmp_path / "in/a*"))
        index.maintain(stream, str(tmp_path / f"ix{folder}"), str(tmp_path / f"ck{folder}")).awaitTermination()
    asked = ranking.questions(spark, ["word1 text"])
    whole = ranking.bm25(ranking.build_index(spark.createDataFrame(docs, schema)), asked)
    grown = ranking.bm25(index.index(spark, str(tmp_path / "ixb")), asked)
    shown = lambda df: {(r[POSITION], round(r.score, 9)) for r in df.collect()}
    assert shown(whole) == shown(grown)


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 10, 5), 7, "a", 2.0), (2, datetime(2024, 1, 1, 10, 50), 7, "a", 3.0), (2, datetime(2024, 1, 1, 10, 50), 7, "a", 3.0), (3, datetime(2024, 1, 1, 13, 0), 8, "b", 1.0)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ev"))
    stream = windows.hourly(windows.first_events(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.table("hours").collect()] == [("a", 2, 5.0)]
    assert windows.sessions(spark.read.parquet(str(tmp_path / "ev"))).count() == 3


def test_changes_and_deletions_equal_a_batch_build(spark, tmp_path):
    """Documents come, change, go and come again over 14 batches; after each the index is that of the state."""
    import random

    from gleaner.operators import ranking
    from gleaner.streaming import changes

    r = random.Random(3)
    path, state = f"file://{tmp_path}/index", {}
    schema = "_pos long, text string, gone boolean, at long"
    sizes = []
    for number in range(14):
        rows = []
        for at in range(r.randint(1, 12)):
            pos = r.randrange(9)
            text = None if r.random() < 0.1 else " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.randrange(6)))
            gone = r.random() < 0.3
            rows.append((pos, text, gone if r.random() < 0.8 or gone else None, at))
            state[pos] = None if gone else text or ""
        for again in range(2 if number in (3, 7) else 1):  # a repeated batch changes nothing
            changes.apply_batch(spark.createDataFrame(rows, schema), number, path, fan=2)
        if number in (0, 1, 6, 7, 12, 13):
            want = ranking.build_index(spark.createDataFrame([(p, t) for p, t in state.items() if t is not None], "_pos long, text string"))
            got = changes.index(spark, path, fan=2)
            for a, b in ((got.tf, want.tf), (got.df, want.df)):
                assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())), number
            assert tuple(got.stats.first()) == tuple(want.stats.first())
            sizes.append(len(changes.runs_of(number + 1, changes._complete(spark, path), 2)))
    assert sizes[-1] == 3  # 8 + 4 + 2 batches
    assert changes.vacuum(spark, path, fan=2) > 10 and len(changes._complete(spark, path)) == 3
    assert sorted(x.term for x in changes.index(spark, path, fan=2).df.collect()) == sorted(x.term for x in want.df.collect())


def test_runs_of_an_unfinished_merge_are_its_parts():
    from gleaner.streaming.changes import runs_of

    there = {(i, i) for i in range(13)} | {(0, 3), (4, 7)}
    assert runs_of(13, there) == [(0, 3), (4, 7), (8, 8), (9, 9), (10, 10), (11, 11), (12, 12)]
    assert runs_of(16, there | {(13, 13), (14, 14), (15, 15), (8, 11), (12, 15), (0, 15)}) == [(0, 15)]
    assert runs_of(0, set()) == []


def test_files_of_a_stream_follow_the_splits_of_its_table(spark):
    from gleaner.plans.files import _files

    rows = spark.range(100)
    assert [_files(rows.repartition(n)) for n in (1, 3, 4, 30)] == [1, 1, 2, 10]
