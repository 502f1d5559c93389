"""Every operator against a brute-force version on awkward small tables."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from gleaner.llm import chat, decontaminate, line_dedup, near_dedup, packing, pii, quality, repeats, support, tokens, warc, words


def test_near_duplicates(edge, pairs):
    found = near_dedup.near_duplicates(edge)
    got = found.collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], brute.near_groups(pairs))
    groups = Counter(r.component_id for r in got if r["first"] and r.n_shingles and r.component_id is not None)
    assert set(groups.values()) == {1}


def test_near_duplicates_of_chains_and_crowded_buckets(spark):
    """Chains whose ends are unlike, and many texts that share a third: small blocks must lose no link."""
    r = random.Random(2)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([*shared, *(f"{g}w{i}" for i in range(60))]) for g in range(40)]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        texts.append(" ".join(chain))
        chain[step * 7] = f"new{step}"
    for t in list(texts[:40]):
        w = t.split()
        w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(df, block=16, bands=64, rows=2)
    same([(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got.collect()], brute.near_groups(docs))


def test_one_large_bucket_of_wide_texts(spark, monkeypatch):
    """A bucket of several slices and, by the bytes of its sets, many blocks; half of it is linked only among itself."""
    monkeypatch.setattr(near_dedup, "SLICE", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    r = random.Random(12)
    shared = [f"s{i}" for i in range(400)]
    texts = []
    for g in range(12):
        own = [*shared, *(f"{g}w{i}" for i in range(330))]
        for _ in range(6):
            w = list(own)
            w[r.randrange(len(w))] = f"edit{r.random()}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    docs = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block=9, bands=64, rows=2)
    same([(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got.collect()], brute.near_groups(docs))


def test_many_null_and_repeated_ids_stay_linear(spark):
    """Thousands of near copies without an id, or all with one: each node's text is read once, not once a node."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(1500):
        w = list(base)
        w[r.randrange(60)] = f"edit{i % 700}"
        texts.append(" ".join(w))
    docs = [(None, t) for t in texts[:750]] + [(5, t) for t in texts[750:]] + [(None, texts[0])] * 300 + [(5, "other words that are alone here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    made = []
    whole = near_dedup.support.materialize

    def counting(table, tag):
        out = whole(table, tag)
        if tag == "sets":
            made.append((out.count(), out.select("node").distinct().count()))
        return out

    near_dedup.support.materialize = counting
    try:
        got = near_dedup.near_duplicates(df).collect()
    finally:
        near_dedup.support.materialize = whole
    assert {x.component_id for x in got if x.n_shingles > 2} == {5} and len(got) == len(docs)
    assert made and made[-1][0] == made[-1][1] and all(rows <= len(docs) for rows, _ in made)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_links_of_a_whole_table_are_all_found(spark):
    """Recall on a table: every pair at 0.75 or more lies in one component."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, set(near_dedup.shingle_sets([t], 5)[0].tolist())) for i, t in rows]
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    assert len(links) > 5 and all(got[i] == got[j] for i, j in links)


def test_superminhash_estimates_and_is_a_permutation_per_element():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sig = near_dedup.superminhash(sets, 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05
    one = near_dedup.superminhash([np.array([7], np.uint64)], 64)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(64))
    parts = near_dedup.superminhash([np.arange(200_000, dtype=np.uint64)], 16)
    halves = near_dedup.superminhash([np.arange(100_000, dtype=np.uint64), np.arange(100_000, 200_000, dtype=np.uint64)], 16)
    assert (parts[0] == halves.min(axis=0)).all()


def test_components_of_random_links(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = support.components(spark.createDataFrame(links, "u long, v long").repartition(6)).collect()
    least = defaultdict(lambda: 10**9)
    for x in up:
        least[find(x)] = min(least[find(x)], x)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {(x.node, x.root) for x in got} == {(x, least[find(x)]) for x in up if x not in loops}


def test_personal_data(edge, pairs):
    got = pii.digests(pii.find_spans(edge)).collect()
    same([tuple(r)[:6] for r in got], [(d, *brute.personal(t)) for d, t in pairs])
    r = random.Random(5)
    alphabets = ["ab@.-+()1204 45 9é\U0001f600\n%_ ", "0123456789 -.+()@a.1", "GB82WEST 12345698765432-"]
    docs = [(i, "".join(r.choice(alphabets[i % 3]) for _ in range(r.choice([5, 60, 300])))) for i in range(240)]
    docs += [(900, "a@b.com_x@y.zz q@ a@b a@b..c 1.2.3.4.5.6.7.8 0000255.01.2.256 4111 1111-1111 1111 41111111111111111111 +1 (743) 555-3824"), (901, "1.1.1.1 " * 3000), (902, "a" * 30_000 + "@b.c " + "1" * 30_000)]
    made = edge.sparkSession.createDataFrame(docs, "doc_id long, text string")
    same([tuple(x)[:6] for x in pii.digests(pii.find_spans(made)).collect()], [(d, *brute.personal(t)) for d, t in docs])


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 x", "iban GB82 WEST 1234 5698 7654 33 x", "ssn 123-45-6789", "it is 123-45-6789", "ssn 9123-45-6789"]
    got = pii.digests(pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).orderBy("doc_id").collect()
    assert [(r.n_iban, r.n_ssn) for r in got] == [(1, 0), (0, 0), (0, 1), (0, 0), (0, 0)] and got[0].spans == "iban:5:32"


def test_contamination(spark, edge, pairs):
    long = [t for _, t in pairs if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[10:40])), (2, " ".join(long[0].split()[30:43]).upper()), (10, "One"), (3, None), (4, "!?"), (None, "one"), (5, "4111 1111 1111"), (5, "10.0.0.1"), (6, long[-1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    same(decontaminate.contamination(edge, bench).collect(), brute.contamination(pairs, items))
    none = decontaminate.contamination(edge, bench.limit(0)).collect()
    assert len(none) == len(pairs) and not any(r.contaminated or r.n_hit for r in none)


def test_a_phrase_in_many_items(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(3000)}"
    phrase = [word() for _ in range(20)]
    items = [(i, " ".join([*(word() for _ in range(5)), *phrase, *(word() for _ in range(5))])) for i in range(150)]
    docs = [(i, " ".join([*(word() for _ in range(i)), *phrase[: 10 + i % 11], *(word() for _ in range(7))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect(), brute.contamination(docs, items))


def test_winnowing_selects_in_every_span():
    r = random.Random(1)
    for n in (5, 13, 14, 60, 500):
        bag = words.Bag([[r.choice("abc").encode() for _ in range(n)], [b"z"] * n])
        chosen = decontaminate.winnow(bag, 8, 13)
        for d in range(2):
            for i in range(n - 12):
                assert chosen[bag.at[d] + i : bag.at[d] + i + 6].any()


def test_recurring_passages(edge, pairs):
    same([tuple(r)[:4] for r in repeats.remove_repeats(edge).collect()], brute.repeats_removed(pairs))


def test_recurring_passages_of_few_words(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("ab") for _ in range(r.choice([0, 3, 12, 60, 200])))) for i in range(30)]
    docs += [(40, "a " * 100), (41, " ".join(map(str, range(200)))), (42, "q " + " ".join(map(str, range(50, 120))))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    same([tuple(x)[:4] for x in repeats.remove_repeats(df, span=12, k=4, shard_chars=500).collect()], brute.repeats_removed(docs, 12))


def test_the_automaton_locates_the_passages():
    """Nothing but the passages of its shard tells where a document has them."""
    import pyarrow as pa

    passage = [f"p{i}" for i in range(70)]
    rows = [
        (1, -1, " ".join(passage), [0, 40, 30, 70]), (1, 5, " ".join(["x", *passage[:40], "y"]), None), (1, 6, " ".join(passage[:39]), None),
        (1, 7, " ".join([*passage[10:], *passage[:25]]), None), (2, 8, " ".join(passage), None),
    ]
    names = ["shard", "row", "text", "bounds"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("bounds", pa.list_(pa.int32()))])) for part in (rows[:2], rows[2:])]
    got = [r for b in repeats._locate(iter(batches)) for r in b.to_pylist()]
    assert [(r["row"], r["n_removed"], r["kept_text"]) for r in got] == [(5, 40, "x y"), (7, 40, " ".join([*passage[10:30], *passage[:25]]))]


def test_more_words_than_one_symbol_holds():
    r = random.Random(11)
    words_ = [f"v{i}".encode() for i in range(70_000)]
    shard = repeats._Shard()
    text = [r.choice(words_) for _ in range(70_000)]
    shard.add(text, [100, 150, 40_000, 40_035, 69_900, 70_000])
    gone = shard.covered([b"unknown", *text])
    assert np.flatnonzero(gone).tolist() == [*range(101, 151), *range(40_001, 40_036), *range(69_901, 70_001)]


@pytest.mark.parametrize("most", [0, quality.MOST])
def test_quality(edge, hosted, most):
    got = quality.quality(edge, most=most, columns=True).collect()
    assert got[0]["doc"]["kept"] == "other" and all(r["doc"]["doc_id"] == r.doc_id for r in got)
    want = [(d, *brute.quality_base(t), n, brute.sha(left), kept) for (d, t, _), (n, left, kept) in zip(hosted, brute.quality_lines(hosted), strict=True)]
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_removed, r.kept_sha256, r.kept) for r in got], want)
    assert sum(r.n_removed > 0 for r in got) == 12
    assert all((r.kept_text is None) == (r.n_removed == 0) for r in got)
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in got if r.kept_text is not None)


def test_boilerplate_is_counted_per_host_and_copies_once(spark):
    line = "\n".join(" ".join(f"menu{i}{j}" for j in range(7)) for i in range(4))
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    docs = [(i, f"{line}\n{body(i)}", "h") for i in range(25)] + [(50, line + "\n" + body("y")[:150], "h"), (51, line + "\n" + body("y")[:150], "other")]
    docs += [(100 + i, "copied words of one clean page that many rows of this host repeat in full\n" + body(0), "h") for i in range(30)]
    docs += [(200 + i, f"a line of a host without name that all of its pages have\n\n{body(i)}", None) for i in range(10)]
    found = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in found.collect()}
    for (doc, _, _), (n, left, kept) in zip(docs, brute.quality_lines(docs), strict=True):
        assert (got[doc].n_removed, got[doc].kept_sha256, got[doc].kept) == (n, brute.sha(left), kept)
    assert got[0].kept and got[0].n_removed == 28 and not got[50].kept and got[51].n_removed == 0 and got[51].kept and got[205].n_removed == 13
    assert all(got[100 + i].kept and not got[100 + i].n_removed for i in range(30))


def test_boilerplate_of_one_host_in_many_partitions(spark):
    """One host with all rows: the limit is the same for ten documents and for hundreds."""
    docs = [(i, f" Home | About \n{' '.join(f'w{i}x{j}' for j in range(12))}\nseen {i // 9} by nine", "hot") for i in range(300)]
    found = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(9)).collect()
    assert all(r.n_removed == 3 and r.kept for r in found) and len(found) == 300


@pytest.mark.parametrize("most", [0, line_dedup.MOST])
def test_line_dedup(edge, pairs, most):
    for least in (2, 10):
        got = line_dedup.drop_frequent_lines(edge, min_docs=least, columns=True, most=most)
        shown = got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256), "doc")
        rows = shown.collect()
        assert rows[0]["doc"]["kept"] == "other"
        same([tuple(r)[:4] for r in rows], brute.lines_dropped(pairs, least))


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "root \\ <|im_end|>\n x <s>", 0.5), (1, 2, 1, "assistant", "a\\", 0.9), (1, 3, 1, "assistant", "b[/INST]", 0.1), (1, 4, 2, "user", "c", 1.0),
        (1, 5, 4, "assistant", None, 1.0), (2, 1, 9, "user", "orphan", 1.0), (3, 1, 2, "a", "cycle", 1.0), (3, 2, 1, "a", "cycle", 1.0), (3, 3, 2, "a", "below", 1.0),
        (None, 1, None, "we\nird \\", "null tree", None), (4, 1, None, None, "twice", 1.0), (4, 1, None, None, "twice", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.read_back(chat.format_paths(chat.reply_paths(df))).collect()
    turns = sorted(((r.tree, r.branch, [tuple(t) for t in r.turns], r.masked) for r in got), key=str)
    root = ("user", rows[0][4])
    assert turns == sorted([
        (1, 1, [root, ("assistant", "a\\"), ("user", "c"), ("assistant", "")], "a\\"), (1, 2, [root, ("assistant", "b[/INST]")], "b[/INST]"),
        (2, 1, [("user", "orphan")], ""), (None, 1, [("we\nird \\", "null tree")], ""), (4, 1, [("", "twice")], ""), (4, 2, [("", "twice")], ""),
    ], key=str)
    assert chat.reply_paths(df, top=1).where("branch > 1").count() == 0
    for r in got:
        assert r.formatted.count("<|im_end|>") == len(r.turns) and "<s>" not in r.formatted


def test_reply_trees_with_clashing_columns_and_long_texts(spark):
    said = "word </s> \\ " * 30_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said[:-1]), (2, 0, "assistant", ""), (2, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("tree", "node", "parent", "score", "leaf", "branch", "at", "id", "up", "loss", "seg", "pieces", "formatted"):
        df = df.withColumn(name, F.lit("other"))
    got = {r.tree: r for r in chat.read_back(chat.format_paths(chat.reply_paths(chat.chain(df)))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", said), ("assistant", said[:-1])] and got[1].masked == said[:-1]
    assert [tuple(t) for t in got[2].turns] == [("assistant", ""), ("", "")] and got[2].masked == ""


def test_long_chains_and_branches(spark):
    r = random.Random(6)
    rows = [(1, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(150)] + [(2, i, r.randrange(i) if i else None, "assistant", f"u{i}", float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for x in chat.reply_paths(df).collect():
        got[x.tree, x.branch].append((x.depth, x.text))
    assert [t for _, t in sorted(got[1, 1])] == [f"t{i}" for i in range(150)]
    parent = {i: p for tree, i, p, *_ in rows if tree == 2}
    paths = []
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        paths.append((-sum(i % 5 for i in path) / len(path), leaf, path[::-1]))
    for n, (_, _, path) in enumerate(sorted(paths), 1):
        assert [t for _, t in sorted(got[2, n])] == [f"u{i}" for i in path]


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    day = 86400
    rows = [
        (1, "HTTP://www.X.org:80/a/?b=2&utm_source=q&a=1#f", 0, "response", h(ETag='"1"', Content_Length="9", X="old"), "d1"),
        (2, "https://x.org/a?a=1&b=2", 10 * day, "revisit", h(etag='W/"1"', content_length="0", x="new", Connection="close"), None),
        (3, "x.org/a?a=1&b=2", 20 * day, "response", h(Last_Modified="m"), "d2"), (4, "x.org/a?a=1&b=2", 20 * day, "revisit", h(ETag='"1"'), None),
        (5, "x.org/a?a=1&b=2", 20 * day + 1, "revisit", h(Last_Modified="n"), None), (6, "x.org/a?a=1&b=2", 30 * day, "revisit", None, "d2"),
        (7, "x.org/a?a=1&b=2", 30 * day, "revisit", {}, None), (8, "other.org", 5, "revisit", {}, None), (9, None, 5, "revisit", {}, None), (10, "x.org/a?a=1&b=2", None, "revisit", {}, None),
        (11, "x.org/a?a=1&b=2", 20 * day, "response", h(Last_Modified="m"), "d2"), (7, "x.org/a?a=1&b=2", 30 * day, "revisit", {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, headers map<string,string>, digest string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumn("canon", F.lit("clash")).withColumn("f", F.lit(1))
    got = sorted(((r.record_id, r.refers_to, r.status, r.headers) for r in warc.resolve_revisits(df, block=day).collect()), key=str)
    merged = {"etag": 'W/"1"', "content-length": "9", "x": "new"}
    stored = {"last-modified": "m"}
    assert got == sorted([
        (2, 1, "not_modified", merged), (4, 1, "not_modified", {"etag": '"1"', "content-length": "9", "x": "old"}), (5, 11, "validator_mismatch", None),
        (6, 11, "not_modified", stored), (7, 11, "unverified", stored), (7, 11, "unverified", stored), (8, None, "no_response", None), (9, None, "no_response", None), (10, None, "no_response", None),
    ], key=str)


def test_revisits_with_clashing_columns_and_long_urls(spark):
    long = "http://x.org/" + "p" * 100_000 + "?" + "&".join(f"k{i}={i}" for i in reversed(range(3000)))
    rows = [(i, long if i % 2 else long.replace("http://x.org", "HTTPS://www.X.org:443") + "#f", i, "revisit" if i % 3 == 2 else "response", {"ETag": f'"{i // 3}"'}, None) for i in range(30)]
    rows += [(90, "", 1, "response", {}, "d"), (91, "", 2, "revisit", {}, "d")]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, headers map<string,string>, digest string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for name in ("canon", "t", "cell", "f", "asked", "near", "far", "m", "status", "refers_to", "canonical_url"):
        df = df.withColumn(name, F.lit("other"))
    got = {r.record_id: (r.refers_to, r.status) for r in warc.resolve_revisits(df).collect()}
    assert got == {i: (i - 1, "not_modified") for i in range(2, 30, 3)} | {91: (90, "not_modified")}


@pytest.fixture(scope="module")
def encode():
    exact = tokens.Encoder(tokens.default_vocabulary()).exact
    return lambda text: exact.encode(text, add_special_tokens=False).ids


def test_token_ids_are_those_of_the_library(pairs, encode):
    r = random.Random(8)
    odd = ["a<|endoftext|>b  c\n\n d", " lead", "trail \n", " x  y", "日本 語\ntext", "\x1c a \x85b", "don't  we'll\t x", "\x00 a b", "<|endoftext|>", "é àb"]
    odd += ["".join(r.choice("ab \n\t'1é 日.") for _ in range(60)) for _ in range(300)]
    texts = odd + [t for _, t in pairs]
    made = tokens.Encoder(tokens.default_vocabulary())
    for t, ids in zip(texts, made.ids(texts), strict=True):
        assert ids.tolist() == encode(t or "")


def _check_sequences(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
    return len(at)


def test_hierarchical_packing(edge, pairs, encode):
    for df, held, whole in ((edge, 1 << 18, False), (edge.repartition(20), 1 << 18, False), (edge, 7, False), (edge.repartition(20), 1 << 18, True), (edge.repartition(9), 5, True)):
        rows = packing.pack_hierarchically(df, capacity=256, buffer_pieces=held, whole_bins=whole).collect()
        want = Counter()
        for doc, text in pairs:
            want.update((doc, i, *v) for (_, i), v in brute.token_pieces([(doc, text)], encode, 256).items())
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        used = _check_sequences(rows, 256)
        least = -(-sum(r.length for r in rows) // 256)
        assert used <= least + (2 if held > 7 else 4) + (4 if whole else 0)


def test_closed_bins_are_items_of_their_fill(spark):
    """Bins of tasks stay together on their way up, over several levels, and every piece finds its place."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "bee", "sea"]) for _ in range(r.choice([3, 9, 20, 31, 45, 58])))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(70)
    tight, closed = (packing.pack_hierarchically(df, capacity=64, whole_bins=w).collect() for w in (False, True))
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(tight) == key(closed)
    few, more = _check_sequences(tight, 64), _check_sequences(closed, 64)
    assert few <= more < 1.15 * few


def test_best_fit_equals_a_plain_loop():
    r = random.Random(4)
    for _ in range(60):
        cap = r.choice([10, 64, 100])
        sizes = [r.randint(1, cap) for _ in range(r.randint(0, 120))]
        bins = []
        for n in sorted(sizes, reverse=True):
            fits = [b for b in bins if b >= n]
            if fits:
                best = min(fits)
                bins.remove(best)
                bins.append(best - n)
            else:
                bins.append(cap - n)
        groups = packing.best_fit(dict(Counter(sizes)), cap)
        assert sum(g[0] for g in groups) == len(bins)
        assert Counter({k: sum(n * t for n, _, w in groups for x, t in w if x == k) for k in set(sizes)}) == Counter(sizes)
        assert all(res == cap - sum(x * t for x, t in w) for _, res, w in groups)


def test_matrices_round_trip(edge, pairs, encode, tmp_path):
    packed = packing.pack_matrices(edge, capacity=128, buffer_tokens=3000)
    packing.write_matrices(packed, str(tmp_path / "m"))
    back = defaultdict(list)
    for r in edge.sparkSession.read.parquet(str(tmp_path / "m")).collect():
        ids = np.frombuffer(r.ids, "<u2")
        bounds = [*r.cu_seqlens]
        assert r.position_ids == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(b - a)]
        assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            back[doc].append((piece, start, ids[a:b].tolist()))
    # Every id of every piece; repeated ids are several documents, whose pieces are counted together.
    got = Counter((doc, piece, start, *ids) for doc, pieces in back.items() for piece, start, ids in pieces)
    want = Counter()
    for doc, text in pairs:
        ids = [*encode(text or ""), 2]
        want.update((doc, i, start, *ids[start : start + n]) for i, (start, n) in enumerate(packing.pieces_of(len(ids), 128)))
    assert got == want


@pytest.mark.parametrize("name", ["near", "pii", "decon", "repeats", "quality", "lines", "matrices", "packing"])
def test_empty_tables(spark, empty, name):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    run = {
        "near": lambda: near_dedup.near_duplicates(empty), "pii": lambda: pii.find_spans(empty), "decon": lambda: decontaminate.contamination(empty, bench),
        "repeats": lambda: repeats.remove_repeats(empty), "quality": lambda: quality.quality(empty), "lines": lambda: line_dedup.drop_frequent_lines(empty),
        "matrices": lambda: packing.pack_matrices(empty), "packing": lambda: packing.pack_hierarchically(empty),
    }
    assert run[name]().count() == 0


def test_empty_trees_and_records(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_paths(chat.reply_paths(chat.chain(none)))).count() == 0
    records = spark.createDataFrame([], "record_id long, url string, ts timestamp, kind string, headers map<string,string>, digest string")
    assert warc.resolve_revisits(records).count() == 0


def test_native_operators_run_no_python(spark, edge):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (pii.find_spans(edge), line_dedup.drop_frequent_lines(edge), chat.read_back(chat.format_paths(chat.reply_paths(chat.chain(turns))))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_parities_rule_out_no_link_and_most_of_the_rest():
    rng = np.random.default_rng(3)
    sets, percent = [], 75
    for size in (1, 5, 40, 127, 129, 1000, 3000, 40_000):
        base = rng.integers(0, 2**63, size, np.uint64)
        for share in (0.0, 0.1, 0.15, 0.45):  # of the elements replaced
            e = base.copy()
            k = int(share * size)
            e[:k] = rng.integers(0, 2**63, k, np.uint64)
            sets.append(np.unique(np.concatenate([e, rng.integers(0, 2**63, size // 9, np.uint64)])))
    told = [near_dedup.parities(e) for e in sets]
    differ, n = near_dedup.differing(told), np.array([len(e) for e in sets])
    out = within = 0
    for x, e in enumerate(sets):
        others = np.arange(len(sets))
        for y, d in zip(others, differ(x, others), strict=True):
            alone = len(np.setxor1d(e, sets[y]))
            assert d <= alone
            allowed = d * (100 + percent) <= (100 - percent) * (n[x] + n[y])
            assert allowed or not near_dedup.similar(e, sets[y], percent)
            if 100 <= n[x] <= 4000 and x // 4 == y // 4 and not near_dedup.similar(e, sets[y], percent):
                out, within = out + (not allowed), within + 1
    assert within > 10 and out > 0.7 * within


def test_second_search_reads_sets_of_members_that_parities_leave(spark):
    marked_rows = [(7, 1, 1, 1), (7, 2, 2, 1), (7, 3, 3, 1), (7, 4, 4, 1), (8, 1, 1, 1), (8, 3, 3, 1)]
    marked = spark.createDataFrame(marked_rows, "key long, node long, root long, blocks int")
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 200, np.uint64)
    sets = {1: base, 2: np.concatenate([base[:190], base[:10] + np.uint64(1)]), 3: np.concatenate([base[:120], rng.integers(0, 2**63, 80, np.uint64)]), 4: base[:20]}
    have = spark.createDataFrame([(k, bytearray(np.unique(e).tobytes())) for k, e in sets.items()], "node long, shingles binary")
    got = near_dedup._parities_allow(marked, have, 512, 75).select("key", "node", "root", "blocks").collect()
    assert sorted(map(tuple, got)) == [(7, 1, 1, 1), (7, 2, 2, 1)]
