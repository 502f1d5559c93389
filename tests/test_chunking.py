import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking
from gleaner.sources.corpus import POSITION, from_records


def brute(text, size, overlap):
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out, k = [], 0
    while spans:
        start = k * (size - overlap)
        end = min(start + size, len(spans))
        a, b = spans[start][0], spans[end - 1][1]
        out.append((k, end - start, start, end, a, b, text[a:b]))
        if end == len(spans):
            return out
        k += 1
    return out


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 0), (5, 4), (7, 3), (60, 10), (200, 40)])
def test_windows_are_those_of_the_formula(spark, size, overlap):
    random.seed(size)
    texts = ["", "   ", None, "one", " lead and trail  "] + ["".join(random.choice(["a", "bc", " ", "\n", "  ", "é😀"]) for _ in range(random.choice([3, 40, 300]))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = chunking.chunk_spans(df, F.col("text"), size=size, overlap=overlap).collect()
    got = sorted((r.n, r.chunk_index, r.tokens, r.token_start, r.token_end, r.char_start, r.char_end, r.chunk_text) for r in rows)
    assert got == sorted((n, *c) for n, t in enumerate(texts) for c in brute(t or "", size, overlap))


def test_blanks_are_those_of_unicode(spark):
    texts = ["a\u00a0b\u2003c d", "\u3000 x\u2028y\x85z\x1cq\x1f", "\x1c\x1d", "zero\u200bwidth stays"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = chunking.chunk_spans(df, F.col("text"), size=2, overlap=1).collect()
    got = sorted((r.n, r.chunk_index, r.tokens, r.token_start, r.token_end, r.char_start, r.char_end, r.chunk_text) for r in rows)
    assert got == sorted((n, *c) for n, t in enumerate(texts) for c in brute(t, 2, 1))


def test_chunks_need_no_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id", "repeat('word ', 400) as text").write.parquet(str(tmp_path / "t"))
    plan = chunking.chunk_spans(spark.read.parquet(str(tmp_path / "t")).repartition(2), F.col("text"), size=12, overlap=4).drop("text")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown and "Python" not in shown and "hashpartitioning" not in shown


def test_sizes_are_checked():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.check_size(size, overlap)


def test_chunk_corpus_keeps_metadata_and_prefers_its_own_fields(spark):
    c = from_records(spark, [{"id": "a", "text": "w " * 7, "title": "T", "tokens": "old"}, {"id": "b", "text": " ", "title": "U", "tokens": "x"}], name="src")
    made = chunking.chunk_corpus(c, size=4, overlap=1, context=F.col("title"), context_name="title")
    rows = made.df.orderBy(POSITION).collect()
    assert made.name == "src_size4_overlap1_title" and [r.id for r in rows] == ["a#0", "a#1"]
    assert rows[0].text == "T\n\nw w w w" and rows[0].source_id == "a" and rows[1].tokens == 4
    stats = chunking.chunk_stats(c.df, made.df).first()
    assert (stats.articles, stats.empty_articles, stats.chunks) == (2, 1, 2)
    with pytest.raises(ValueError):
        chunking.chunk_corpus(c, name="src")


def test_sentences_are_packed(spark):
    df = spark.createDataFrame([("One two. Three! Four five six seven? End",)], "text string")
    got = [r.chunk_text for r in chunking.sentence_chunks(df, F.col("text"), size=3).orderBy("chunk_index").collect()]
    assert got == ["One two. Three!", "Four five six seven?", "End"]
    got = [r.chunk_text for r in chunking.sentence_chunks(df, F.col("text"), size=100, max_sentences=2).orderBy("chunk_index").collect()]
    assert got == ["One two. Three!", "Four five six seven? End"]


def test_chunks_of_any_tokenizer(spark):
    texts = ["ab cd  ef", None, "", "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    spans = lambda t: [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    got = chunking.token_chunks(df, F.col("text"), spans, size=2, overlap=1).collect()
    found = sorted((r.n, r.chunk_index, r.tokens, r.token_start, r.token_end, r.char_start, r.char_end, r.chunk_text) for r in got)
    assert found == sorted((n, *c) for n, t in enumerate(texts) for c in brute(t or "", 2, 1))
