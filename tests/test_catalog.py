"""Catalogue queries against their SQL, and what the driver asks of the entry module."""

from __future__ import annotations

import ast
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent
#: A few of each kind; the whole catalogue is compared at a larger scale by the driver.
CHOSEN = ["retrieve_sparse", "retrieve_hybrid", "retrieve_recency", "retrieval_metrics_summary", "rerank_max_per_source", "chunk_overlap", "curate_per_source", "citations_extract", "kg_subgraph_2hop", "compare_period_delta", "validate_rules"]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_tables
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(catalog.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    assert Counter(tuple(shown(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(shown(r[order.index(c)]) for c in columns) for r in want.fetchall())


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_import_the_training_data_subpackage():
    for path in (ROOT / "gleaner").rglob("*.py"):
        if path.is_relative_to(ROOT / "gleaner/llm"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("gleaner.llm") for n in names), path


def test_words_in_documents_are_found_letter_for_letter(spark, tmp_path):
    """Sharp s is no double s, and a mark or a raised digit behind a word does what the SQL's pattern says."""
    spark.createDataFrame([(0, "ungeheuß straßenbahn strassenbahn anderes"), (1, "andereß")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "UNGEHEUSS"), (2, "Strassenbahn und Straßenbahn"), (3, "straßenbahń x"), (4, "anderes² andereſ"), (5, None), (6, "andereß‿ungeheuß")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["kg_find_in_documents"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["kg_find_in_documents"](spark, f"file://{tmp_path}").collect()) == sorted(want)
    assert (2, "strassenbahn,straßenbahn") in want and (1, "") in want
