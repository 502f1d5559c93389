"""The source of wrapped JSON: decoding at every block size, filters against Spark's own, partitions and streams."""

from __future__ import annotations

import json
import os

import pytest

from gleaner.sources import wrapped

RECORDS = [
    {"id": 1, "text": 'a "quoted] } \\ text', "score": 0.5, "tags": ["x", None], "at": {"y": 1}}, {"id": 2, "text": None, "ok": True}, {"id": 12345678901, "text": "déjà \U0001f600"},
    {}, {"id": "seven", "text": {"deep": [1, {"a": "]"}]}, "score": 3, "tags": "no list"}, {"id": -4, "text": "x" * 1000, "ok": "yes", "score": True},
]
SCHEMA = "id long, text string, score double, ok boolean, tags array<string>, at struct<y: int>"


def pieces(text, size):
    return lambda: iter([text[i : i + size] for i in range(0, len(text), size)])


@pytest.mark.parametrize("size", [1, 2, 7, 100, 10_000])
def test_records_are_decoded_from_any_blocks(size):
    for text in (
        json.dumps(RECORDS), json.dumps(RECORDS, indent=2), json.dumps({"meta": {"records": [1]}, "data": RECORDS, "n": 12}), json.dumps({"items": [0], "records": RECORDS, "rows": 3}),
        json.dumps({"data": "text", "rows": RECORDS}), " " + json.dumps({"items": [[1, 2], {}], "rows": RECORDS}) + "\n",
    ):
        assert list(wrapped.records(pieces(text, size))) == RECORDS
    assert list(wrapped.records(pieces('{"mine": [12, 345], "records": []}', size), "mine")) == [12, 345]
    assert list(wrapped.records(pieces("[]", size))) == [] and list(wrapped.records(pieces('{"rows": [ ]}', size))) == []
    for bad in ("", "7", '{"a": [1]}', '[{"a": 1}', '[1 2]', "{}", '{"records": {}}'):
        with pytest.raises(ValueError):
            list(wrapped.records(pieces(bad, size)))


@pytest.fixture
def folder(spark, tmp_path):
    wrapped.register(spark)
    for i in range(5):
        (tmp_path / f"f{i}.json").write_text(json.dumps({"records": [dict(r, n=i) for r in RECORDS * 3]}))
    (tmp_path / "_SUCCESS").write_text("")
    return f"file://{tmp_path}"


def test_columns_filters_and_partitions(spark, folder):
    read = lambda **o: spark.read.format("wrapped_json").schema(f"_file string, _record long, {SCHEMA}, n int").options(**o).load(folder)
    whole = read(partitionBytes=1)
    assert whole.rdd.getNumPartitions() == 5 and read().rdd.getNumPartitions() == 1
    rows = whole.orderBy("_file", "_record").collect()
    assert len(rows) == 90 and [(r._record, r.n) for r in rows[:19]] == [(i, 0) for i in range(18)] + [(0, 1)]
    assert tuple(rows[0])[2:8] == (1, 'a "quoted] } \\ text', 0.5, None, ["x", None], (1,)) and rows[2].id == 12345678901 and rows[1].ok is True
    assert tuple(rows[3])[2:8] == (None,) * 6 and tuple(rows[4])[2:8] == (None, '{"deep": [1, {"a": "]"}]}', 3.0, None, None, None) and tuple(rows[5])[4:6] == (None, None)
    held = spark.createDataFrame(rows, whole.schema)
    for where, sql in (
        ([["id", "=", 1]], "id = 1"), ([["id", ">", 1], ["text", "null", False]], "id > 1 and text is not null"), ([["id", "<=", -4]], "id <= -4"), ([["id", "in", [1, 2]]], "id in (1, 2)"),
        ([["id", "null", True]], "id is null"), ([["id", "<>", 1]], "id <> 1"), ([["text", "prefix", "a"]], "text like 'a%'"), ([["text", "suffix", "xx"]], "text like '%xx'"),
        ([["text", "contains", "quo"]], "text like '%quo%'"), ([["ok", "=", True]], "ok"), ([["text", ">=", "d"]], "text >= 'd'"), ([["_record", "<", 2], ["n", "=", 3]], "_record < 2 and n = 3"), ([], "true"),
    ):
        assert sorted(map(str, read(where=json.dumps(where)).collect())) == sorted(map(str, held.where(sql).collect())), where
    one = read(partitionBytes=1, where=json.dumps([["_file", "suffix", "f3.json"]]))
    assert one.rdd.getNumPartitions() == 1 and {r.n for r in one.collect()} == {3}
    # Filters of one use of a DataFrame do not reach another.
    assert whole.where("id = 1").unionByName(whole.where("id = 2")).count() == 30 and whole.count() == 90


def test_refusals_and_empty_folders(spark, folder, tmp_path):
    source = lambda: spark.read.format("wrapped_json")
    with pytest.raises(Exception, match="needs a schema"):
        source().load(folder)
    with pytest.raises(Exception, match="no columns of type map"):
        source().schema("m map<string,int>").load(folder).collect()
    for where in ([["x", "=", 1]], [["id", "~", 1]], [["id", "=", "1"]], [["id", "in", [True]]]):
        with pytest.raises(Exception, match="where: "):
            source().schema("id long").option("where", json.dumps(where)).load(folder).collect()
    (tmp_path / "none").mkdir()
    assert source().schema("id long").load(f"file://{tmp_path}/none").isEmpty()
    (tmp_path / "none" / "cut.json").write_text('{"records": [{"id": 1}, {"id"')
    with pytest.raises(Exception):
        source().schema("id long").load(f"file://{tmp_path}/none").collect()


def test_a_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("wrapped_json").schema("id long, n int").load(folder)
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
        return {r.n: r["count"] for r in spark.read.parquet(f"{base}/out").groupBy("n").count().collect()}

    assert run() == {i: 18 for i in range(5)}
    path = folder[len("file://") :]
    with open(f"{path}/.f9", "w") as f:
        json.dump([{"id": 1, "n": 9}], f)
    os.rename(f"{path}/.f9", f"{path}/a9.json")
    assert run() == {**{i: 18 for i in range(5)}, 9: 1}


def test_what_is_written_is_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'q"\n\\', [1, None], (2, "x")), (2, None, None, None), (None, "\u2028\U0001f600", [], (None, None))], "id long, text string, l array<long>, s struct<a: long, b: string>")
    path = f"file://{tmp_path}/out"
    wrapped.write(rows, path, files=3, key="items")
    wrapped.write(rows.limit(0), path)
    back = spark.read.format("wrapped_json").schema(rows.schema).load(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    names = os.listdir(tmp_path / "out")
    assert names and not [n for n in names if n.startswith(".") and not n.endswith(".crc")]
    assert spark.read.json(f"{tmp_path}/out", multiLine=True).columns == ["items"]
    with pytest.raises(Exception, match="only adds files"):
        rows.write.format("wrapped_json").mode("overwrite").save(path)
