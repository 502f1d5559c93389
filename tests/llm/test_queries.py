"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gleaner.llm import queries, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
TABLES = ["documents", "embeddings", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    shown = duck.execute(queries.ORACLES[name])
    order = [d[0] for d in shown.description]
    assert sorted(order) == columns
    want = Counter(tuple(r[order.index(c)] for c in columns) for r in shown.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def brute_pipeline(docs, bench):
    docs = [(d, left if n else t) for (d, t, _), (n, left, kept) in zip(docs, brute.quality_lines(docs), strict=True) if kept]
    docs = [(d, t) for (d, _), t in zip(docs, brute.lines_left([t for _, t in docs]), strict=True)]
    kept = {r[0] for r in brute.near_groups(docs) if r[3]}
    docs = [d for d in docs if d[0] in kept]
    bad = {r[0] for r in brute.contamination(docs, bench) if r[-1]}
    return [d for d in docs if d[0] not in bad]


def test_pipeline_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in read("documents").collect()]
    bench = [(r.item_id, r.text) for r in read("benchmark").collect()]
    exact = tokens.Encoder(tokens.default_vocabulary()).exact
    want = brute.token_pieces(brute_pipeline(docs, bench), lambda t: exact.encode(t, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing" and len(corpus_pipeline.STAGES) == 5


def _encoded(spark, capacity):
    exact = tokens.Encoder(tokens.default_vocabulary()).exact
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        yield r.doc_id, ids, [*cuts, len(ids)]


def test_matrices_hold_every_id(spark):
    got = {}
    rows = queries.QUERIES["op4_bfd_matrices"](spark, SF).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == 2048 and r.resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens and not any(ids[r.n_tokens :])
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert (doc, piece) not in got
            got[doc, piece] = (start, ids[a:b])
    want = {(d, i): (a, ids[a:b]) for d, ids, cuts in _encoded(spark, 2048) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert got == want
    least = -(-sum(len(x) for _, x in got.values()) // 2048)
    assert len(rows) <= least * 1.02 + 2


def test_packed_pieces_and_their_places(spark):
    rows = queries.QUERIES["op10_hierarchical_packing"](spark, SF).collect()
    want = {(d, i): (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for d, ids, cuts in _encoded(spark, 1024) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(at) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_the_crawl_asks_for_the_latest_of_several_responses(spark):
    found = queries.QUERIES["op1_warc_revisits"](spark, SF).collect()
    assert {r.status for r in found} >= {"no_response", "not_modified", "validator_mismatch"}
    assert {r.refers_to % 4 for r in found if r.refers_to is not None} == {0, 1}
    assert 5 * sum(r.canonical_url == "hot.example.com/list?a=1&b=2" for r in found) >= len(found) / 2


def test_the_line_rule_decides_on_a_whole_table(spark):
    """Boilerplate is removed, and rejects documents that pass the base rules."""
    got = queries.QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_removed > 0 for r in got) == 41 and sum(not r.kept and not r.base_failed for r in got) == 3


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
