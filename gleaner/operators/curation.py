"""Curation of evidence, prompts, and checks of an answer's citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx

MAX_PASSAGES, MAX_CHARS, MAX_FACTS, KEY_CHARS = 8, 1500, 20, 300


def curate(
    passages: DataFrame, *, max_passages: int = MAX_PASSAGES, max_chars: int = MAX_CHARS, order: str = "edges", max_per_source: int | None = None
) -> DataFrame:
    """From ``(qid, rank, id, source_id, text)``: the sources to show, with label, position and drop counts.

    Blank texts go unseen; repeats (by their first 300 normalised characters) and rows over the source cap are
    counted; then the first ``max_passages`` stay.  ``edges`` puts the best first and last, the weakest inside.
    """
    if order not in ("edges", "relevance"):
        raise ValueError(f"order must be edges or relevance, got {order!r}")
    w = Window.partitionBy("qid")
    source = F.coalesce(F.col("source_id").cast("string"), F.col("id").cast("string")) if "source_id" in passages.columns else F.col("id")
    df = passages.withColumn("__key", F.substring(tx.collapse(F.col("text")), 1, KEY_CHARS)).where(F.col("__key") != "").withColumn("__source", source)
    df = df.withColumn("__copy", F.row_number().over(Window.partitionBy("qid", "__key").orderBy("rank")))
    df = df.withColumn("dropped_duplicates", F.sum((F.col("__copy") > 1).cast("long")).over(w)).where("__copy = 1")
    df = df.withColumn("__nth", F.row_number().over(Window.partitionBy("qid", "__source").orderBy("rank")))
    over = F.lit(False) if max_per_source is None else F.col("__nth") > max_per_source
    df = df.withColumn("dropped_over_source_limit", F.sum(over.cast("long")).over(w)).where(~over)
    df = df.withColumn("label_rank", F.row_number().over(w.orderBy("rank"))).where(F.col("label_rank") <= max_passages)
    n, r = F.count("*").over(w), F.col("label_rank")
    at = r if order == "relevance" else F.when(r % 2 == 1, F.expr("(label_rank + 1) div 2")).otherwise(n - F.expr("label_rank div 2") + 1)
    df = df.withColumn("position", at.cast("int")).withColumn("label", F.concat(F.lit("S"), r.cast("string")))
    return df.withColumn("text", tx.clip(F.col("text"), max_chars)).drop("__key", "__source", "__copy", "__nth", "label_rank")


def curate_facts(facts: DataFrame, *, max_facts: int = MAX_FACTS) -> DataFrame:
    """Distinct facts by their folded description, the first ``max_facts`` of each question, labelled G1, G2, …

    ``facts`` has ``qid, _pos`` and the fact's columns.
    """
    told = tx.describe_fact(*[F.col(c) for c in ("subject", "subject_type", "relation", "object", "object_type", "date")])
    df = facts.withColumn("description", told).withColumn("__key", F.lower("description"))
    df = df.withColumn("__copy", F.row_number().over(Window.partitionBy("qid", "__key").orderBy("_pos"))).where("__copy = 1")
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy("_pos"))).where(F.col("__n") <= max_facts)
    return df.withColumn("label", F.concat(F.lit("G"), F.col("__n").cast("string"))).drop("__key", "__copy", "__n")


def source_block(label: Column, title: Column, date: Column, url: Column, text: Column) -> Column:
    """``[S1] title · date · url`` above the text, without the parts that are blank."""
    parts = F.filter(F.array(title, date, url), lambda p: F.coalesce(p, F.lit("")) != "")
    head = F.concat(F.lit("["), label, F.lit("]"), F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " · "))).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def prompts(curated: DataFrame, questions: DataFrame, facts: DataFrame | None = None, instructions: str | None = None) -> DataFrame:
    """``(qid, prompt)``: the question, sources in their positions, facts, and what to do with them."""
    value = lambda c: F.col(c).cast("string") if c in curated.columns else F.lit(None).cast("string")
    block = source_block(F.col("label"), value("title"), value("date"), value("url"), F.col("text"))
    blocks = curated.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("bs"))
    blocks = blocks.select("qid", F.array_join(F.transform("bs", lambda x: x.b), "\n\n").alias("sources"))
    df = questions.join(blocks, "qid", "left")
    parts = [F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Sources:\n\n"), F.coalesce("sources", F.lit("(none)")))]
    if facts is not None:
        number = F.substr("label", F.lit(2)).cast("int")
        lines = facts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.concat(F.lit("["), "label", F.lit("] "), "description").alias("l")))).alias("fs"))
        df = df.join(lines.select("qid", F.array_join(F.transform("fs", lambda x: x.l), "\n").alias("facts")), "qid", "left")
        parts.append(F.concat(F.lit("Facts:\n"), F.col("facts")))
    if instructions:
        parts.append(F.lit(f"Instructions: {instructions}"))
    parts.append(F.lit("Answer the question and cite the sources and facts used by their labels."))
    return df.select("qid", F.concat_ws("\n\n", *parts).alias("prompt"))


def citation_report(answers: DataFrame, known: Column, known_facts: Column | None = None) -> DataFrame:
    """``cited`` (known labels only), ``unknown_citations``, ``uncited_sources`` and ``uncited_facts`` of ``(qid, answer)``."""
    facts = F.array().cast("array<string>") if known_facts is None else known_facts
    df = answers.withColumn("__c", tx.extract_citations(F.col("answer"))).withColumn("__k", known).withColumn("__f", facts)
    both = F.concat("__k", "__f")
    return df.select(
        *answers.columns, F.array_intersect("__c", both).alias("cited"), F.array_except("__c", both).alias("unknown_citations"),
        F.array_except("__k", "__c").alias("uncited_sources"), F.array_except("__f", "__c").alias("uncited_facts"),
    )


HEADING = r"(?i)^(?:sources?|references|bibliography)$"


def citation_coverage(answers: DataFrame) -> DataFrame:
    """``(qid, statements, cited_statements, coverage)`` of ``(qid, answer)``.

    Lines up to a heading of sources count, without Markdown headings and without lines that begin with a
    label.  A piece with a word outside citations is a statement; a piece of citations alone credits the
    statement before it on its line.
    """
    lines = answers.select("qid", F.posexplode(F.split(F.coalesce("answer", F.lit("")), "\n")).alias("line", "body"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("body"), r"^[*#_ ]+|[*#_ ]+$", ""), ":+$", ""))
    upto = Window.partitionBy("qid").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("over", F.max(bare.rlike(HEADING).cast("int")).over(upto)).where("over = 0")
    lines = lines.where(~F.trim("body").rlike("^#") & ~F.trim("body").rlike(r"^(?:[-*]\s*)?\[\s*[SG]\d+"))
    pieces = lines.select("qid", "line", F.posexplode(tx.statement_pieces(F.trim("body"))).alias("piece", "part"))
    outside = F.regexp_replace("part", tx.CITATION_GROUP, " ")
    pieces = pieces.select("qid", "line", "piece", outside.rlike(r"(?U)[^\W_]").alias("word"), F.col("part").rlike(tx.CITATION_GROUP).alias("cite"))
    so_far = Window.partitionBy("qid", "line").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("statement", F.sum(F.col("word").cast("int")).over(so_far)).where("statement > 0")
    counted = pieces.groupBy("qid", "line", "statement").agg(F.max(F.col("cite").cast("int")).alias("cite"))
    counted = counted.groupBy("qid").agg(F.count("*").alias("statements"), F.sum("cite").alias("cited_statements"))
    out = answers.select("qid").join(counted, "qid", "left").na.fill(0, ["statements", "cited_statements"])
    share = F.col("cited_statements") / F.nullif(F.col("statements"), F.lit(0))
    return out.select("qid", "statements", "cited_statements", F.bround(share, 3).alias("coverage"))
