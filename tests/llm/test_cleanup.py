"""Cleanup is one run's own, and the decontamination SQL follows the operator on items without an id."""

from __future__ import annotations

import threading

import duckdb
from conftest import same

from gleaner.llm import decontaminate, sql, support


def test_two_runs_keep_their_tables(spark):
    """A run that cleans up in one thread leaves the tables of another."""
    other, ready, done = [], threading.Event(), threading.Event()

    def run():
        other.append(support.materialize(spark.range(5).toDF("a"), "other"))
        ready.set()
        done.wait(60)
        other.append(other[0].count())

    thread = threading.Thread(target=run)
    began = support.mark()
    mine = support.materialize(spark.range(3).toDF("a"), "mine")
    thread.start()
    assert ready.wait(60)
    support.release(began)
    done.set()
    thread.join()
    assert other[1] == 5 and support.mark() == began
    support.discard(other[0])
    assert not any(path == other[0]._gleaner_path for tables in support._everyones for _, path in tables)
    assert mine._gleaner_path not in str(support._everyones)


def test_sql_counts_hits_of_items_without_an_id(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "a b " + words), (2, "nothing here"), (3, "few words x"), (4, None)]
    items = [(None, words), (7, "few words"), (8, "few words"), (None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    told = con.execute(sql.ORACLES["op5_winnowing_decontamination"])
    order = [d[0] for d in told.description]
    want = told.fetchall()
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same([tuple(r[c] for c in order) for r in got.collect()], want)
    assert {r[order.index("doc_id")]: r[order.index("n_hit")] for r in want}[1] == 20
