import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import bloom, graph


def test_grams_of_many_lengths_pass_their_filter_once_a_text(spark):
    names = ["a", "b c", "c d e", "d", "e f g h", "b b"]
    texts = {1: "a b c d a b c", 2: "", 3: "x y z", 4: "e f g h", 5: "b b b b", 6: "c d e"}
    hashed = lambda df: df.select("h", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))
    cut = hashed(spark.createDataFrame([(h, t.split()) for h, t in texts.items()], "h long, w array<string>").coalesce(1))
    grams = hashed(spark.createDataFrame([(0, n.split()) for n in names], "h long, w array<string>").coalesce(1))
    got = [tuple(r) for r in bloom.likely_grams(cut, [1, 2, 3, 4], bloom.filter_of(grams.select("hashes"))).collect()]
    want = {(h, len(n.split()), n) for h, t in texts.items() for n in names if f" {n} " in f" {t} "}
    assert len(got) == len(set(got)) and set(got) >= want and len(got) <= len(want) + 1


def test_a_filter_is_made_of_columns_and_not_row_by_row():
    words = np.arange(12, dtype=np.uint64)
    for n in (1, 2, 5):
        whole = bloom.gram_hashes(words, n)
        assert whole.tolist() == bloom._mixed([words[j : j + len(whole)] for j in range(n)], len(whole)).tolist()


def test_names_of_a_lookup_are_made_once(spark, monkeypatch):
    g = graph.from_records(spark, [{"subject": "Acme Corp", "relation": "in", "object": "Rome"}, {"subject": "Acme Corp", "relation": "in", "object": "Große Straße"}])
    made = []
    kept = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: made.append(df.columns) or kept(df))
    texts = spark.createDataFrame([(1, "rome and ACME  corp"), (2, "GROSSE STRASSE, grosse straẞe"), (3, None)], "id int, text string")
    got = {r.id: r.entities for r in g.find_entities(texts).collect()}
    assert got == {1: ["Rome", "Acme Corp"], 2: ["Große Straße"], 3: []} and made == [["key", "name", "n", "gram"]]
