"""Language identification, words first: a known word speaks by its log frequency in each language, an unseen one by its n-grams.

The model is fitted on a bounded sample of labelled rows: in each language at most ``sample`` rows, those of smallest
hash of id.  Words and n-grams of the sample are counted by Spark; the ``words`` and ``grams`` most frequent ones
(shared out evenly over the languages) are kept, so the model that is broadcast has a proven size bound, whatever the
corpus has: at most ``words + grams`` rows of one number a language.  Every row of the table is then scored where it is
read; no text is shuffled for it.

A word is a run of letters in lower case.  A known word adds round(1000 ln((c + 0.5) / (C + V / 2))) to each language (c
its count there, C all counts, V the known words).  An unseen word with a blank at both ends is cut into n-grams of
five letters; if the model knows any of them, the floor of their mean log frequencies is added, else n-grams of four,
down to one; a word without a known letter adds nothing.  The language's share of the sample's rows is added as a
prior.  The largest sum wins, ties go to the smallest name.  The score is the winner's share after a softmax of the
sums, tempered by the square root of the number of words that counted, because the words of a text are not independent.
All sums are integers, so nothing depends on order or partitioning.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is everything when no row can be
learned from.  A null id is learned from (it is not in the held-out class, ``held_out`` is false) and sorts last in
the sample; equal hashes (repeated ids) go by text.  Long texts are scored whole.  Language, source and id are never
read by a prediction; other columns are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.words import make_room

LETTERS = regex.compile(r"\p{L}+")
LONGEST = 5
UND = "und"
#: Unseen words whose sums a worker remembers.
REMEMBERED = 100_000


def held_out(id_: Column) -> Column:
    """The quarter of the ids that is never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """At most ``sample`` rows of each language, by the smallest hash of their id: ``lang, text``."""
    may = docs.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = may.select(F.md5(F.col(id_col).cast("string").cast("binary")).alias("hash"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # Written, so that the planner sees how few languages there are.  Twice the expected share passes before any text is sorted; then the exact bound, cut in each task before the shuffle.
    share = support.materialize(rows.groupBy("lang").agg((F.lit(2.0 * sample) / F.count("*")).alias("share")), "share")
    at = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    some = rows.join(share, "lang").where(F.coalesce(at, F.lit(1.0)) <= F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.col("hash").asc_nulls_last(), F.col("text"))
    return some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("lang", "text")


def _top(counts: DataFrame, most: int) -> DataFrame:
    """Counts of the ``most`` most frequent keys of each language and size, in all languages."""
    order = Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "key")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return counts.join(first.select("size", "key").distinct(), ["size", "key"], "left_semi")


@dataclass
class Model:
    """Integer log frequencies: ``known[key]`` is the row of ``logs`` for a word, or for an n-gram behind a NUL."""

    langs: list[str]
    prior: np.ndarray
    known: dict[str, int]
    logs: np.ndarray


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.round(1000 * np.log((counts + 0.5) / (counts.sum(axis=0) + len(counts) / 2))).astype(np.int64)


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample: int, words: int, grams: int) -> Model:
    """The model of a bounded sample; the driver gets at most ``words + grams`` keys."""
    learned = support.materialize(labelled_sample(docs, id_col, text_col, lang_col, sample), "sample")
    rows = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rows)
    if not langs:
        return Model([], np.zeros(0, np.int64), {}, np.zeros((0, 0), np.int64))
    total = np.array([rows[x] for x in langs], float)
    known: dict[str, int] = {}
    parts: list[np.ndarray] = []
    counted = learned.select("lang", F.explode(_words(F.col("text"))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    counts = support.materialize(counted.select("lang", F.lit(0).alias("size"), "key", "n"), "counts")
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(padded)))).alias("size")
    cut = counts.select("lang", "n", padded.alias("word"), sizes)
    starts = F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)
    cut = cut.select("lang", "n", "size", F.explode(F.transform(starts, lambda i: F.substring("word", i, F.col("size")))).alias("key"))
    cut = support.materialize(cut.where("key <> ' '").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")), "grams")
    # Each size has frequencies of its own; size 0 stands for whole words.
    kept = _top(counts, words // len(langs)).unionByName(_top(cut, grams // LONGEST // len(langs)), allowMissingColumns=True).toArrow()
    sized = np.array(kept.column("size"))
    for size in range(LONGEST + 1):
        some = kept.filter(pa.array(sized == size))
        keys, lang = (some.column(c).combine_chunks().dictionary_encode() for c in ("key", "lang"))
        matrix = np.zeros((len(keys.dictionary), len(langs)))
        matrix[keys.indices.to_numpy(), np.array([langs.index(x) for x in lang.dictionary.to_pylist()], int)[lang.indices.to_numpy()]] = some.column("n").to_numpy()
        base = len(known)
        known.update((("\0" if size else "") + k, base + i) for i, k in enumerate(keys.dictionary.to_pylist()))
        parts.append(_logs(matrix))
    support.discard(learned, counts, cut)
    return Model(langs, np.round(1000 * np.log(total / total.sum())).astype(np.int64), known, np.concatenate(parts))


class Scorer:
    """Scores texts in one task; sums of unseen words are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, model.known
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.sums = np.zeros((REMEMBERED, len(self.model.langs)), np.int64)

    def backoff(self, word: str) -> np.ndarray | None:
        """Floor of the mean log frequencies of the word's longest known n-grams; nothing if no letter is known."""
        padded, known = f" {word} ", self.known
        for size in range(min(LONGEST, len(padded)), 0, -1):
            rows = [r for i in range(len(padded) - size + 1) if (r := known.get("\0" + padded[i : i + size])) is not None]
            if rows:
                return self.model.logs[rows].sum(axis=0) // len(rows)
        return None

    def _row(self, word: str) -> int:
        """Row of the word in the model's table, or behind it in the remembered sums; -1 if it says nothing."""
        row = self.known.get(word)
        if row is None:
            row = self.seen.get(word)
            if row is None:
                sums = self.backoff(word)
                row = -1
                if sums is not None:
                    free = len(self.seen)
                    self.sums[free] = sums
                    row = len(self.model.logs) + free
                self.seen[word] = row
        return row

    def score(self, text: str | None) -> tuple[str, float]:
        if not self.model.langs or text is None:
            return UND, 0.0
        found = LETTERS.findall(text.lower())
        if not found:
            return UND, 0.0
        total, n, size = self.model.prior.copy(), 0, len(self.model.logs)
        for at in range(0, len(found), REMEMBERED):  # a part has no more unseen words than are remembered
            part = found[at : at + REMEMBERED]
            if len(self.seen) + len(part) > REMEMBERED:
                self._forget()
            rows = np.fromiter(map(self._row, part), np.int64, len(part))
            total += self.model.logs[rows[(rows >= 0) & (rows < size)]].sum(axis=0) + self.sums[rows[rows >= size] - size].sum(axis=0)
            n += int((rows >= 0).sum())
        best = int(total.argmax())
        tempered = (total - total[best]) / (1000 * max(1.0, n**0.5))
        return self.model.langs[best], round(1.0 / float(np.exp(tempered).sum()), 6)


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, words: int = 100_000, grams: int = 200_000
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model of the rows that are not held out."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample, words=words, grams=grams)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = support.type_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        scorer = Scorer(shared.value)
        for batch in batches:
            told = [scorer.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(support.lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
