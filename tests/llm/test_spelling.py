"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from conftest import same

from gleaner.llm import spelling


def edits(w):
    letters = [chr(c) for c in (*range(97, 123), *range(192, 256))]
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def variants(docs, least_count=3):
    total = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= least_count}
    near = {w: [x for x in edits(w) if x in n] if len(w) < 1000 else [] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]


def misspelt(seed, words=60, docs=40):
    r = random.Random(seed)
    letters = "abcdeéÿ×ab"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(words)]
    base[3::4] = [w + "é" for w in base[0::4]]  # variants that have variants
    out = []
    for d in range(docs):
        text = []
        for _ in range(300):
            w = base[min(int(r.expovariate(0.3)), words - 1)]
            if r.random() < 0.4:
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
            text.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((d, r.choice([" ", "-", "1", "Ā", "日"]).join(text)))
    return out


def test_edge_table(spark, edge, pairs):
    same(spelling.spelling_variants(edge).collect(), variants(pairs))


def test_empty_table(spark, empty):
    got = spelling.spelling_variants(empty)
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_many_shards_and_rounds(spark, monkeypatch):
    """Small shards and broadcasts: neighbours lie in other shards and rounds, and ties go to the smallest word."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", 11)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 9000)
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = misspelt(5)
    want = variants(docs)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] and w[2] != w[1] for w in want)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(spelling.spelling_variants(df).collect(), want)


def test_hot_word_long_words_and_repeated_rows(spark):
    long = "y" * 30_000
    docs = [(1, f"{long} {long}x {long} plain"), (1, f"{long} {long}x {long} plain"), (2, long + "x plain plaim " + "plain " * 5000), (None, "plaim plaim " + long + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df).collect()}
    assert got[long] == (None, long, 4, 1, None) and got[long + "x"] == (None, long + "x", 4, 1, None)
    assert got["plaim"] == ("plain", "plain", 3, 1, got["plain"][2])


def test_chains_end_at_their_root(spark):
    """Each word is the form of the one before; the last of 30 has the largest count."""
    links = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(30)]
    got = spelling.follow(spark.createDataFrame(links, "word string, form string").repartition(3)).collect()
    same(got, [(w, "w30") for w, _ in links])


def test_trie_finds_exactly_the_words_at_one_edit():
    r = random.Random(8)
    words = sorted({bytes(r.choice(b"abc\xe9") for _ in range(r.randint(1, 6))) for _ in range(700)})
    trie = spelling.Trie(spelling.build(words, list(range(1, len(words) + 1))))
    for w in words[::7] + [b"aaaaaa", b"zzz", b"aabbcca"]:
        near = {x.encode("latin-1") for x in edits(w.decode("latin-1"))} & set(words)
        assert set(trie.near(w)) == near and all(words[n - 1] == x for x, n in trie.near(w).items())
