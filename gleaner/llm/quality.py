"""Quality rules: whole-text repetition rules and cross-document line frequency by host.

Lines are normalised (blanks stripped, A-Z lowered) and hashed.  Per host, each distinct document is counted
once for each of its lines; lines with words that at least ``min_docs`` distinct documents of the host have are
boilerplate and are removed from every text of the host.  The limit is a fixed number, so it does not grow with
the host.  A document that is left with fewer than ``min_words`` words, or less than ``min_left`` of its words,
is depleted and rejected, as are documents that fail the base rules.  Rows of one host with the same whole text
are one document in this count, so that copying alone makes no line boilerplate and no clean document fails
for it; copies are the business of the deduplication operators.

Two passes read the texts.  The first sends a hash of every distinct line of a document, seeded by its host, and
counts them with map-side combination, so one host with a third of all rows stays spread over all tasks.  The
second measures the texts and cuts them: up to ``MOST`` boilerplate hashes (a bounded set of numbers) go to the
workers, so no text is shuffled.  More than that are joined with the documents' hashes instead, and the texts
with those; both ways remove the same lines.

Defined cases: a null or wordless text has no words and fails the base rules; a null host is a host of its
own; lines without words are never removed; repeated rows and ids give one row each; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import Bag, as_long, covered, grams, make_room, slices

BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_DROP_SYMBOLS = bytes.maketrans(b"", b""), _SYMBOLS
_KEEP_STARTS = bytes(range(0x80, 0xC0)) + BLANKS


def repeated_words(bag: Bag, width: int = 5) -> np.ndarray:
    """Per document, the words inside ``width``-word windows that occur twice or more in it."""
    g = grams(bag.h, width)
    at = np.flatnonzero(bag.left()[: len(g)] >= width)
    out = np.zeros(len(bag.n), np.int64)
    if not len(at):
        return out
    doc, h = bag.doc[at], g[at]
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (s[1:] == s[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = covered(len(bag.h), at[order[twice]], width)
    return np.bincount(bag.doc[hit], minlength=len(bag.n)).astype(np.int64) if hit.any() else out


#: Boilerplate hashes that are sent to the workers (512 KB).
MOST = 1 << 16


def _seed(host: str | None) -> int:
    """Hashes of lines of different hosts do not meet."""
    return xxhash.xxh3_64_intdigest(b"none" if host is None else b"host " + host.encode("utf-8", "surrogatepass"))


def _line_hash(line: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(line.strip(BLANKS).lower(), seed)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _lines(data: bytes, seed: int, gone: Set[int]) -> tuple[int, int, bytes]:
    """Repeated lines, words in lines that are gone, and the text without these lines."""
    seen: set[bytes] = set()
    again = removed = 0
    kept = []
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                again += 1
            else:
                seen.add(line)
            if gone and _line_hash(line, seed) in gone:
                removed += n
                continue
        kept.append(line)
    return again, removed, b"\n".join(kept) if removed else data


def quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_words: int = 10,
    repeat_percent: int = 20,
    min_docs: int = 10,
    min_words: int = 10,
    min_left: float = 0.7,
    columns: bool = False,
    most: int = MOST,
) -> DataFrame:
    """One row per document: its counts, ``n_removed`` (words in boilerplate lines), ``base_failed``, ``kept``, ``kept_sha256``, ``kept_text``.

    ``kept_text`` is the text without boilerplate lines, null where nothing was removed; ``kept_sha256`` is the
    digest of what is left in either case.  With ``columns`` also the whole input row as the struct ``doc``.
    """
    kind = support.type_of(docs, id_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if columns else F.lit(None).cast("int")
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"), whole.alias("doc")
    )
    content = F.struct(F.xxhash64("host", "text").alias("a"), F.hash("host", "text").alias("b"))

    def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            found = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = _seed(host)
                found.append(list({_line_hash(x, seed) for x in set(_bytes(text).split(b"\n")) if x.split()}))
            lists = [as_long(np.array(x, np.uint64)) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names[2:], "lines"])

    def hashes_of(rows: DataFrame, key: Column, of: str) -> DataFrame:
        return rows.select("host", "text", key.alias("key")).mapInArrow(support.lean(line_hashes), f"key {of}, lines array<long>")

    seen = support.materialize(hashes_of(base, content, "struct<a: long, b: int>"), "lines")
    one = seen.groupBy("key").agg(F.first("lines").alias("lines"))  # copies on one host once
    common = one.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("line")
    common = support.materialize(common, "boilerplate")
    support.discard(seen)
    few = common.limit(most + 1).toArrow().column(0).to_numpy()
    rows, shared = base.withColumn("drop", F.lit(None).cast("array<long>")), few.view(np.uint64)
    if len(few) > most:
        keyed, row = support.keyed(base)
        lines = hashes_of(keyed, F.col(row), "long").select("key", F.explode("lines").alias("line"))
        drop = lines.join(common, "line").groupBy("key").agg(F.collect_list("line").alias("drop"))
        rows, shared = keyed.join(drop, F.col(row) == F.col("key"), "left").drop(row, "key"), np.empty(0, np.uint64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        common = set(shared.tolist())
        for batch in batches:
            hosts, texts, drops = (batch.column(i).to_pylist() for i in (1, 2, 4))
            for a, b in slices(texts):
                data = [_bytes(t) for t in texts[a:b]]
                bag = Bag([x.split() for x in data])
                gone = [common if d is None else {h & 0xFFFFFFFFFFFFFFFF for h in d} for d in drops[a:b]]
                cut = [_lines(x, _seed(host), g) for x, host, g in zip(data, hosts[a:b], gone, strict=True)]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(bag.n, pa.int64()),
                    pa.array([len(x.translate(None, _KEEP_STARTS)) for x in data], pa.int64()),
                    pa.array([len(x) - len(x.translate(*_DROP_SYMBOLS)) for x in data], pa.int64()),
                    pa.array([again for again, _, _ in cut], pa.int64()),
                    pa.array(repeated_words(bag), pa.int64()),
                    pa.array([removed for _, removed, _ in cut], pa.int64()),
                    pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in cut]),
                    pa.array([kept.decode("utf-8", "surrogatepass") if removed else None for _, removed, kept in cut], pa.string()),
                    batch.column(3).slice(a, b - a),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "kept_sha256", "kept_text", "doc"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + f", kept_sha256 string, kept_text string, doc {support.type_of(base, 'doc')}"
    measured = rows.select("doc_id", "host", "text", "doc", "drop").mapInArrow(support.lean(measure), schema)
    n, removed = F.col("n_words"), F.col("n_removed")
    failed = (n < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * n)
    depleted = (removed > 0) & ((n - removed < min_words) | (n - removed < min_left * n))
    return measured.select(*names[:7], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *names[7:9], *(["doc"] if columns else []))
