"""The pipeline's stages where ids are null or repeat: each row has its own verdict."""

from __future__ import annotations

from collections import Counter

import brute
import pytest
from conftest import edge_rows

import corpus_pipeline
from gleaner.llm import tokens


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_quality_verdicts_are_of_rows(spark, edge, hosted):
    got = corpus_pipeline.quality_rules(spark, edge, "")
    assert got.columns == edge.columns
    assert counted(got) == Counter((d, left if n else t) for (d, t, _), (n, left, kept) in zip(hosted, brute.quality_lines(hosted), strict=True) if kept)
    assert all(r.n_chars == len(r.text) for r in got.where("doc_id >= 20").collect())


def test_near_dedup_keeps_one_row_of_a_group(spark, edge):
    rows = [r[:2] for r in edge_rows()]
    # Unique ids in the order of (null last, id, row) make the brute force choose the row that has to stay.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    ranked = [(n, rows[i][1]) for n, i in enumerate(order)]
    want = Counter(rows[order[n]] for n, _, _, kept in brute.near_groups(ranked) if kept)
    assert counted(corpus_pipeline.near_dedup_stage(spark, edge, "")) == want
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (None, "A B C D E F")], "doc_id long, text string")
    assert counted(corpus_pipeline.near_dedup_stage(spark, twice, "")) == Counter([(1, "a b c d e f"), (None, "g h i j k l")])


@pytest.mark.parametrize("which", [6, 8, None])
def test_contaminated_rows_go_whatever_their_id(spark, edge, tmp_path, which):
    text = [t for d, t, *_ in edge_rows() if d == which][-1]
    item = " ".join(text.split()[-20:])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = [r[:2] for r in edge_rows()]
    want = Counter(p for p, r in zip(pairs, brute.contamination(pairs, [(1, item)]), strict=True) if not r[-1])
    assert sum(want.values()) < len(pairs)
    assert counted(corpus_pipeline.decontamination(spark, edge, str(tmp_path))) == want


def test_line_limit_does_not_grow_with_the_host(spark):
    """A line in 25 of a host's 226 documents is boilerplate and leaves the texts; only the page that has little else goes."""
    line = " ".join(f"menu{j}" for j in range(12))
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = [(i, f"{line}\n{body(i)}" if i < 24 else body(i), "h") for i in range(225)] + [(900, line + "\nshort", "h"), (901, line + "\nshort", "other")]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), "")
    assert {r.doc_id: r.text for r in got.collect()} == {i: body(i) for i in range(225)} | {901: line + "\nshort"}


def test_line_dedup_stage_of_rows(spark, edge):
    got = corpus_pipeline.line_dedup_stage(spark, edge, "")
    rows = [r[:2] for r in edge_rows()]
    want = Counter((d, k) for (d, _, _, k) in brute.lines_dropped(rows))
    assert got.columns == edge.columns and Counter((r.doc_id, brute.sha(r.text)) for r in got.collect()) == want


def test_all_stages_after_each_other(spark, edge, hosted, tmp_path):
    """Rows are told apart by their number among equal (id, text) pairs; ids repeat and are null."""
    item = " ".join(next(t for d, t, _ in hosted if d == 25).split()[20:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(d, left if n else t) for (d, t, _), (n, left, kept) in zip(hosted, brute.quality_lines(hosted), strict=True) if kept]
    lines = brute.lines_left([t for _, t in rows])
    rows = [(d, t) for (d, _), t in zip(rows, lines, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    ranked = [(n, rows[i][1]) for n, i in enumerate(order)]
    rows = [rows[order[n]] for n, _, _, kept in brute.near_groups(ranked) if kept]
    rows = [p for p, r in zip(rows, brute.contamination(rows, [(1, item)]), strict=True) if not r[-1]]
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert counted(docs) == Counter(rows) and docs.columns == edge.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    exact = tokens.Encoder(tokens.default_vocabulary()).exact
    want = Counter((d, *v) for d, t in rows for v in brute.token_pieces([(d, t)], lambda t: exact.encode(t, add_special_tokens=False).ids).values())
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_empty_tables_pass_through(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
