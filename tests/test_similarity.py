"""The set-similarity join and its groups against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import similarity, tasks
from gleaner.operators.components import components


def brute(docs, threshold):
    sets = [(i, frozenset((t or "").lower().split())) for i, t in docs]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    share = round(1000 * threshold)
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or 1000 * len(a & b) >= share * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    out = {}
    for i, _ in sets:
        out[find(i)] = out.get(find(i), 0) + 1
    return out


def texts(seed):
    r = random.Random(seed)
    out = []
    common = [f"c{i}" for i in range(12)]
    for _ in range(40):
        base = r.sample(common, r.randint(1, 12)) + [f"w{r.randrange(300)}" for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"w{r.randrange(300)}"
            out.append(" ".join(w))
    out += ["", None, " ", "c1", "c1 c1", "c1 c2"] + [" ".join(r.sample(common, 6)) for _ in range(60)]  # few words, many sharers
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("threshold,hot", [(0.8, 1024), (0.5, 5), (1.0, 3), (0.3, 4), (0.75, 7)])
def test_groups_equal_all_pairs(spark, threshold, hot):
    docs = texts(int(100 * threshold))
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    found = similarity.similarity_groups(df, F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), " +"), F.col("id"), threshold=threshold, hot=hot)
    got = {r.root: r.n for r in found.groupBy("root").agg(F.sum("copies").alias("n")).collect()}
    assert got == brute(docs, threshold)


def test_few_frequent_tokens_are_ranked(spark, monkeypatch):
    """The order of rarity decides the work, never the result."""
    docs = texts(3)
    df = spark.createDataFrame(docs, "id long, text string")
    whole = similarity.prefixes
    for most in (0, 5):
        monkeypatch.setattr(similarity, "prefixes", lambda nodes, share, most=most: whole(nodes, share, most))
        found = similarity.similarity_groups(df, F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), " +"), F.col("id"), threshold=0.6, hot=9)
        assert {r.root for r in found.collect()} == set(brute(docs, 0.6))


def test_near_duplicates_keep_the_first_row(spark):
    base = " ".join(f"word{i}" for i in range(40))
    docs = [(5, base), (3, base.replace("word7", "other")), (9, base.upper() + "!"), (1, "something else"), (2, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, body string").withColumn("copies_of", F.lit(1))
    got = tasks.deduplicate_near(df, F.col("body"), "doc_id", threshold=0.9)
    assert {(r.doc_id, r.copies) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)} and got.columns == ["doc_id", "body", "copies_of", "copies"]
    assert tasks.deduplicate_near(df.limit(0), F.col("body"), "doc_id").collect() == []
    with pytest.raises(ValueError):
        tasks.deduplicate_near(df, F.col("body"), "doc_id", threshold=0)


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    assert got == {x: find(x) for a, b in links for x in (a, b) if a != b}


def test_signatures_leave_few_pairs_and_lose_none(spark):
    """Pairs that only share rare tokens do not meet their whole sets; every similar pair does."""
    r = random.Random(5)
    sets = [(i, sorted(r.sample(range(-(1 << 40), 1 << 40), r.choice((1, 30, 300, 3000))))) for i in range(60)]
    sets += [(100 + i, sorted({*ids[: max(1, len(ids) - len(ids) // 10)], *range(len(ids) // 20)})) for i, ids in sets]
    nodes = spark.createDataFrame([(i, ids, len(ids)) for i, ids in sets], "node long, ids array<long>, n int")
    pairs = spark.createDataFrame([(u, v) for u, _ in sets for v, _ in sets if v < u], "u long, v long")
    left = {tuple(x) for x in similarity.candidates(pairs, nodes, similarity.signatures(nodes, similarity.LONG), 800).collect()}
    tokens = {i: set(ids) for i, ids in sets}
    true = {(u, v) for u in tokens for v in tokens if v < u and 10 * len(tokens[u] & tokens[v]) >= 8 * len(tokens[u] | tokens[v])}
    assert len(true) >= 60 and true <= left and len(left) < 1.2 * len(true)
