from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHES = ["row", "kept", "component_id", "n_words", "content", "host", "self", "h", "bands", "sequence_id", "node", "length", "offset", "found", "doc", "at", "t", "lo", "__kept", "__row", "__kept_key", "__kept_text"]


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, exact and near copies, repeated rows and ids, shared lines and passages."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "CHANGED"
    shared = "Read the Terms of use here"
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n\r\x0b\x0c ", "en", "s", 3), (4, "one", "en", "s", 3), (5, "ONE", "en", "s", 3),
        (6, base, "en", "s", 1), (7, base, "en", "s", 1), (7, base, "en", "s", 1), (8, " ".join(near), "en", "t", 1), (8, "same id, other text " + prose(30), "en", "t", 1),
        (None, base.upper(), "en", "t", 1), (None, prose(12), "en", None, 1), (9, "a b c d " * 40, "en", "s", 1), (10, prose(9000), "en", "s", 1),
        (11, "x" * 50_000, "en", "s", 1), (12, "\n" * 300, "en", "s", 1), (13, "nul\x00 and \U0001f600 card 4111 1111 1111 1111, ip 10.0.0.1, a@b.co", "en", "s", 1),
    ]
    rows += [(20 + i, f"{prose(15)}\n {shared} \n{prose(40)} {passage} {prose(20)}\n{shared.upper()}", "en", "s", 1) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def hosted():
    return [(r[0], r[1], r[3]) for r in edge_rows()]


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in edge_rows()]


def same(got, want):
    a, b = sorted(map(tuple, got), key=str), sorted(map(tuple, want), key=str)
    assert a == b
