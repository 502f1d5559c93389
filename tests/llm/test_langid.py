"""Language identification against a plain version, and its accuracy on held-out rows."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import same

from gleaner.llm import langid


def letters(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def grams(word, size):
    w = f" {word} "
    return [g for i in range(len(w) - size + 1) if (g := w[i : i + size]) != " "]


def predicted(docs, sample=4000, words=100_000, n_grams=200_000):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    by = defaultdict(list)
    for i, text, lang in docs:
        if not held(i) and text is not None and lang is not None:
            by[lang].append((i is None, hashlib.md5(str(i).encode()).hexdigest(), text))
    learned = {lang: [t for _, _, t in sorted(x)[:sample]] for lang, x in by.items()}
    langs = sorted(learned)
    counts = {0: {lang: Counter(w for t in learned[lang] for w in letters(t)) for lang in langs}}
    for z in range(1, 6):
        counts[z] = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, n in counts[0][lang].items():
                for g in grams(w, z):
                    counts[z][lang][g] += n
    logs = {}
    for z, c in counts.items():
        most = (words if z == 0 else n_grams // 5) // max(1, len(langs))
        keys = {k for lang in langs for k, _ in sorted(c[lang].items(), key=lambda x: (-x[1], x[0]))[:most]}
        whole = {lang: sum(c[lang][k] for k in keys) for lang in langs}
        logs[z] = {k: [round(1000 * math.log((c[lang][k] + 0.5) / (whole[lang] + len(keys) / 2))) for lang in langs] for k in keys}
    rows = sum(map(len, learned.values()))
    prior = [round(1000 * math.log(len(learned[lang]) / rows)) for lang in langs]
    out = []
    for i, text, _ in docs:
        found, total, n = letters(text), list(prior), 0
        for w in found:
            say = logs[0].get(w)
            for z in range(5, 0, -1):
                if say is None and (some := [logs[z][g] for g in grams(w, z) if g in logs[z]]):
                    say = [sum(x) // len(some) for x in zip(*some, strict=True)]
            if say is not None:
                total, n = [a + b for a, b in zip(total, say, strict=True)], n + 1
        if not found or not langs:
            out.append((i, held(i), "und", 0.0))
            continue
        best = max(total)
        score = 1 / sum(math.exp((x - best) / (1000 * max(1.0, n**0.5))) for x in total)
        out.append((i, held(i), langs[total.index(best)], round(score, 6)))
    return out


def rows(docs):
    return [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 5)) for r in docs.collect()]


def near(want):
    return [(i, h, lang, round(s, 5)) for i, h, lang, s in want]


def labelled(table):
    return [(r.doc_id, r.text, r.lang) for r in table.select("doc_id", "text", "lang").collect()]


def test_edge_table(spark, edge):
    same(rows(langid.identify(edge)), near(predicted(labelled(edge))))


def test_languages_ties_and_small_bounds(spark):
    """Few words and n-grams are kept, samples are cut, texts without known letters go by the prior, equal sums by name."""
    docs = [(i, f"der die das wort{i % 7} und nicht {i}", "de") for i in range(40)] + [(100 + i, f"the of and word{i % 5} not {i}", "en") for i in range(40)]
    docs += [(200, "日本", None), (201, "123", "en"), (202, None, "de"), (203, "", None), (204, "nichts unword", None), (205, "ΣΑΣ", "el"), (206, "Die" * 3000 + " the", None), (None, "the und", "en"), (207, "der die das wort1 und nicht", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    for bounds in ({}, {"sample": 9, "words": 12, "grams": 90}):
        same(rows(langid.identify(df, **bounds)), near(predicted(docs, **{{"grams": "n_grams"}.get(k, k): v for k, v in bounds.items()})))


def test_nothing_to_learn_from(spark, empty):
    assert langid.identify(empty).collect() == []
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    same(rows(langid.identify(df)), [(1, False, "und", 0.0), (2, False, "und", 0.0)])


def test_lang_source_and_id_are_no_inputs(spark):
    docs = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "xx" if i % 2 else "yy") for i in range(40)]
    told = {i: lang for i, _, lang, _ in rows(langid.identify(spark.createDataFrame([*docs, (900, "uno dos", "xx"), (903, "uno dos", "yy")], "doc_id long, text string, lang string")))}
    assert told[900] == told[903] == "yy"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    all_, right = told.count(), told.where("lang = lang_pred").count()
    assert all_ > 150 and right >= 0.97 * all_
