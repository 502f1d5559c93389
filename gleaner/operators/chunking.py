"""Chunking: overlapping windows of words, sentences, and contexts before chunks, as exploded rows.

One regular expression with possessive repeats cuts a text into contiguous blocks of as many words as divide both the
window and its step, so there is no Python on the path and no backtracking.  A chunk is a few whole blocks after each
other without the blanks at its end; its offset is the running total of the blocks' lengths.  All of a record's chunks are made inside its row and exploded last:
nothing is shuffled, and no text is copied to a chunk but its own.

Blanks are those of Unicode, the four ASCII separators and the next-line character among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.session import spread
from gleaner.sources.corpus import POSITION, Corpus, numbered

#: A word character's and a blank's class, for patterns with (?U).
W, B = r"[^\s\x1c-\x1f]", r"[\s\x1c-\x1f]"
#: The characters of the class B.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def check_size(size: int, overlap: int) -> None:
    if size < 1:
        raise ValueError(f"size must be at least 1, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be at least 0 and less than size, got {overlap} for size {size}")


def chunk_spans(df: DataFrame, text: Column, *, size: int = 200, overlap: int = 0) -> DataFrame:
    """Every column of ``df`` with ``chunk_index, chunk_count, tokens, token_start, token_end, char_start, char_end, chunk_text``.

    Windows start every ``size - overlap`` words and stop with the one that reaches the end; records without a
    word give no rows.
    """
    check_size(size, overlap)
    step = size - overlap
    t = F.coalesce(text, F.lit(""))
    part = gcd(size, step)
    blocks = F.regexp_extract_all(t, F.lit(rf"(?U)({W}++(?:{B}++{W}++){{0,{part - 1}}}+{B}*+)"), F.lit(1))
    lead = F.length(F.regexp_extract(t, rf"(?U)^({B}*+)", 1))
    base = spread(df).select("*", blocks.alias("__b"), lead.cast("long").alias("__lead"))
    last = F.regexp_count(F.try_element_at("__b", F.lit(-1)), F.lit(rf"(?U){W}++"))
    base = base.select("*", ((F.size("__b") - 1) * part + last).alias("__n"), tx.running_totals(F.transform("__b", lambda x: F.length(x).cast("long"))).alias("__at"))
    n = F.col("__n")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")

    def chunk(row: Column, k: Column) -> Column:
        first = k * (step // part)
        whole = F.array_join(F.slice(row.blocks, first + 1, size // part), "")
        return F.struct(k.alias("k"), (row.lead + F.get(row.at, first)).cast("int").alias("start"), F.rtrim(whole, F.lit(BLANKS)).alias("text"))

    # Bound to a variable, because the planner would put the expressions themselves into the function of each chunk.
    bound = F.struct(F.col("__b").alias("blocks"), F.col("__at").alias("at"), F.col("__lead").alias("lead"))
    base = base.select("*", count.alias("chunk_count"))
    chunks = tx.let(bound, lambda row: F.transform(F.sequence(F.lit(0), F.col("chunk_count") - 1), lambda k: chunk(row, k)))
    made = base.select("*", F.when(F.size("__b") > 0, chunks).alias("__c"))
    # explode_outer, because from explode the planner derives a filter on the whole array and computes it once more where the texts are read.
    rows = made.select(*[F.col(f"`{c}`") for c in df.columns], "chunk_count", "__n", F.explode_outer("__c").alias("__c")).where("__c is not null")
    start = F.col("__c.k") * step
    end = F.least(start + size, n)
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__c.k").alias("chunk_index"), "chunk_count", (end - start).alias("tokens"), start.alias("token_start"),
        end.alias("token_end"), F.col("__c.start").alias("char_start"), (F.col("__c.start") + F.length("__c.text")).alias("char_end"), F.col("__c.text").alias("chunk_text"),
    )


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def file_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Places of a tokenizer file's tokens, without special ones; loaded once per worker."""
    return lambda text: _tokenizer(path).encode(text, add_special_tokens=False).offsets


def token_chunks(df: DataFrame, text: Column, spans: Callable[[str], list[tuple[int, int]]], *, size: int = 200, overlap: int = 0) -> DataFrame:
    """The same columns as ``chunk_spans``, counted in the tokens of ``spans(text) -> [(start, end)]``, in Arrow batches."""
    check_size(size, overlap)
    step, own = size - overlap, len(df.columns)
    added = ["chunk_index", "chunk_count", "tokens", "token_start", "token_end", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cut = [], []
            for i, t in enumerate(batch.column(own).to_pylist()):
                at = [s for s in spans(t or "") if s[1] > s[0]]
                count = 0 if not at else 1 if len(at) <= size else -(-(len(at) - size) // step) + 1
                for k in range(count):
                    a, b = k * step, min(k * step + size, len(at))
                    start, end = at[a][0], at[b - 1][1]
                    rows.append((i, k, count, b - a, a, b, start, end))
                    cut.append(t[start:end])
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            at_row = pa.array(columns[0], pa.int32())
            arrays = [c.take(at_row) for c in batch.columns[:own]] + [pa.array(c, pa.int32()) for c in columns[1:]] + [pa.array(cut, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:own], *added, "chunk_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("__t", text).mapInArrow(run, ", ".join([fields, *(f"{c} int" for c in added), "chunk_text string"]))


def sentence_chunks(df: DataFrame, text: Column, *, size: int = 200, max_sentences: int | None = None) -> DataFrame:
    """Whole sentences packed up to ``size`` words (or ``max_sentences``); a longer sentence is a chunk of its own."""
    sentences = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), rf"(?U)(?<=[.!?]){B}+"), lambda s: F.trim(s) != "")
    n = lambda s: F.regexp_count(s, F.lit(rf"(?U){W}++"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("words"), F.lit(0).alias("count"))

    def add(a: Column, s: Column) -> Column:
        full = a.words + n(s) > size
        if max_sentences is not None:
            full = full | (a["count"] >= max_sentences)
        new = (a["count"] > 0) & full
        return F.struct(
            F.when(new, F.concat(a.done, F.array(a.now))).otherwise(a.done).alias("done"),
            F.when(new | (a["count"] == 0), s).otherwise(F.concat(a.now, F.lit(" "), s)).alias("now"),
            F.when(new, n(s)).otherwise(a.words + n(s)).alias("words"),
            F.when(new, F.lit(1)).otherwise(a["count"] + 1).alias("count"),
        )

    packed = F.aggregate(sentences, empty, add, lambda a: F.when(a["count"] > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done))
    rows = df.select("*", packed.alias("__p")).select("*", F.size("__p").alias("chunk_count"), F.posexplode("__p").alias("chunk_index", "chunk_text"))
    return rows.withColumn("tokens", n(F.col("chunk_text"))).drop("__p")


def with_context(chunks: DataFrame, context: Column | None) -> DataFrame:
    """``context`` (null when blank) and ``text``: the context, a blank line and the chunk."""
    told = F.lit(None).cast("string") if context is None else F.nullif(F.trim(context), F.lit(""))
    chunks = chunks.withColumn("context", told)
    return chunks.withColumn("text", F.when(F.col("context").isNull(), F.col("chunk_text")).otherwise(F.concat("context", F.lit("\n\n"), "chunk_text")))


def chunk_corpus(
    corpus: Corpus, *, size: int = 200, overlap: int = 0, context: Column | None = None, context_name: str = "none", variant: str | None = None,
    name: str | None = None, spans: Callable[[str], list[tuple[int, int]]] | None = None,
) -> Corpus:
    """A corpus of chunks ``<source id>#<k>`` that keeps its parents' metadata; by words, or by the tokens of ``spans``."""
    default = corpus.name + (f"_{variant}" if variant else "") + f"_size{size}_overlap{overlap}" + (f"_{context_name}" if context_name != "none" else "")
    name = name or default
    if name == corpus.name:
        raise ValueError("a chunk corpus needs another name than its source")
    own = {"id", "source_id", "text", "context", "chunk_text", "chunk_index", "chunk_count", "tokens", "token_start", "token_end", "char_start", "char_end"}
    meta = [c for c in corpus.df.columns if c not in own | {corpus.id_field, corpus.text_field, POSITION}]
    parent = corpus.df.select(F.col(POSITION).alias("__parent"), corpus.id.alias("source_id"), corpus.text.alias("__text"), *[F.col(f"`{c}`") for c in meta])
    cut = chunk_spans(parent, F.col("__text"), size=size, overlap=overlap) if spans is None else token_chunks(parent, F.col("__text"), spans, size=size, overlap=overlap)
    rows = with_context(cut, context).drop("__text")
    rows = rows.withColumn("id", F.concat("source_id", F.lit("#"), F.col("chunk_index").cast("string")))
    rows = numbered(rows, ["__parent", "chunk_index"]).drop("__parent")
    return Corpus.of(rows, name, id_field="id", text_field="text", source=corpus.source)


def chunk_stats(corpus: DataFrame, chunks: DataFrame, id_column: str = "id") -> DataFrame:
    """One row: articles, articles without a chunk, chunks, and least, median and most tokens."""
    articles = corpus.agg(F.count("*").alias("articles"))
    told = chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct("source_id").alias("chunked"), F.min("tokens").alias("min_tokens"),
        F.median("tokens").alias("median_tokens"), F.max("tokens").alias("max_tokens"),
    )
    return articles.crossJoin(told).select("articles", (F.col("articles") - F.col("chunked")).alias("empty_articles"), "chunks", "min_tokens", "median_tokens", "max_tokens")


def title_of(text: Column) -> Column:
    """First sentence, as a stand-in where a table has no title."""
    return F.regexp_extract(text, r"^\s*([^.!?\n]*)", 1)
