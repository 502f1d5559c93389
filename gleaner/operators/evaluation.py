"""Evaluation: samples for test questions, retrieval metrics for all questions at once, and checks of judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx

DEFAULT_K = (1, 3, 5, 10)
#: The criteria of an answer, each with what a judge is asked.
CRITERIA = {
    "faithfulness": "Is every claim of the answer supported by the sources it was given?",
    "relevance": "Does the answer address the question that was asked?",
    "completeness": "Does the answer cover what the sources offer on the question?",
    "citations": "Do the citations stand where they belong and point to sources that say so?",
    "correctness": "Does the answer agree with the reference answer?",
}
QUESTION_TYPES = ("factual", "temporal", "comparison", "multi_source", "opinion")


def sample(df: DataFrame, id_col: Column, text: Column, *, size: int = 20, seed: int = 0, min_chars: int = 500) -> DataFrame:
    """``size`` eligible records in an order that a seed fixes: by a hash of id and seed, the same in any engine."""
    key = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))
    return df.where(F.length(text) >= min_chars).withColumn("__key", key).orderBy("__key").limit(size).drop("__key")


def sample_stratified(df: DataFrame, id_col: Column, stratum: Column, *, per_stratum: int, seed: int = 0) -> DataFrame:
    key = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("__s").orderBy("__key")
    df = df.withColumn("__s", stratum).withColumn("__key", key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_stratum).drop("__s", "__key", "__n")


def even_sample(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows spread evenly over an order: places ``floor(i * n / size)`` of n rows."""
    from gleaner.sources.corpus import POSITION, numbered

    rows = numbered(df.drop(POSITION), list(order))
    n = rows.count()
    if n <= size:
        return rows.drop(POSITION)
    at = F.floor((F.col(POSITION) * size + n - 1) / F.lit(n))
    return rows.where((at < size) & (F.floor(at * F.lit(n) / F.lit(size)) == F.col(POSITION))).drop(POSITION)


def clean_questions(replies: DataFrame, *, per_record: int = 1, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """From ``(record, at, question, answer, type)``: questions that stand alone, numbered q1, q2, …

    Blank ones and those that point at "this article" go; repeats are dropped whatever their case; unknown
    types become null; each record keeps ``per_record``.
    """
    q, a = F.trim("question"), F.trim("answer")
    ok = (F.coalesce(q, F.lit("")) != "") & (F.coalesce(a, F.lit("")) != "") & ~tx.points_at_source(q)
    df = replies.where(ok).select("record", "at", q.alias("question"), a.alias("answer"), F.when(F.col("type").isin(list(types)), F.col("type")).alias("type"))
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("record", F.lower("question")).orderBy("at"))).where("__n = 1")
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("record").orderBy("at"))).where(F.col("__n") <= per_record).drop("__n")
    from gleaner.sources.corpus import numbered

    rows = numbered(df, ["record", "at"], "__q")
    return rows.withColumn("qid", F.concat(F.lit("q"), (F.col("__q") + 1).cast("string"))).drop("__q")


def type_counts(questions: DataFrame, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """Questions of every asked type, zero where there are none."""
    every = questions.sparkSession.createDataFrame([(i, t) for i, t in enumerate(types)], "__at int, type string")
    counted = questions.groupBy("type").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, "type", "left").orderBy("__at").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def retrieval_metrics(questions: DataFrame, runs: DataFrame, qrels: DataFrame, *, ks: int | Sequence[int] = DEFAULT_K, digits: int | None = 4) -> DataFrame:
    """Per question: ``precision_at_k, recall_at_k, hit_at_k`` for each k, and the reciprocal rank.

    ``runs`` has ``(qid, rank, id)``; an id found twice counts once, at its best rank.  Precision divides by k;
    recall is null for a question without relevant ids.  One plan serves all questions.
    """
    ks = sorted({ks} if isinstance(ks, int) else set(ks))
    if not ks or ks[0] < 1:
        raise ValueError(f"k must be at least 1, got {ks}")
    once = runs.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")))
    relevant = qrels.select("qid", "id").distinct()
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = once.join(relevant.withColumn("hit", F.lit(1)), ["qid", "id"], "left_semi").groupBy("qid").agg(
        *[F.count_if(F.col("rn") <= k).alias(f"found_{k}") for k in ks], F.min("rn").alias("first")
    )
    df = questions.select("qid").join(n_rel, "qid", "left").join(hits, "qid", "left")
    shown = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    out = ["qid"]
    for k in ks:
        found = F.coalesce(F.col(f"found_{k}"), F.lit(0))
        out += [
            shown(found / F.lit(float(k))).alias(f"precision_at_{k}"),
            shown(found / F.col("n_rel")).alias(f"recall_at_{k}"),
            (found > 0).cast("int").cast("double").alias(f"hit_at_{k}"),
        ]
    return df.select(*out, shown(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"))


def metric_means(metrics: DataFrame, by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """Means over questions of every metric, nulls left out; the mean reciprocal rank is ``mrr``."""
    names = [c for c in metrics.columns if c not in ("qid", *by)]
    mean = (lambda c: F.bround(F.avg(c), digits)) if digits is not None else F.avg
    told = [mean(c).alias("mrr" if c == "reciprocal_rank" else c) for c in names]
    return metrics.groupBy(*by).agg(F.count("*").alias("questions"), *told)


def average_precision(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid, average_precision, ndcg, r_precision)`` of questions with relevant ids, over their whole runs."""
    relevant = qrels.select("qid", "id").distinct()
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    once = runs.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")))
    hits = once.join(relevant, ["qid", "id"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rn"))).join(n_rel, "qid")
    told = hits.groupBy("qid").agg(
        F.sum(F.col("nth") / F.col("rn")).alias("ap"), F.sum(1 / F.log2(F.col("rn") + 1)).alias("dcg"), F.count_if(F.col("rn") <= F.col("n_rel")).alias("r")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n_rel").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    df = n_rel.join(told, "qid", "left").na.fill(0, ["ap", "dcg", "r"])
    return df.select("qid", (F.col("ap") / F.col("n_rel")).alias("average_precision"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("r") / F.col("n_rel")).alias("r_precision"))


def clean_judgements(replies: DataFrame) -> DataFrame:
    """``(…, criterion, score, rationale, claims)`` with scores as whole numbers from 1 to 5 and blank claims gone."""
    number = F.expr("try_cast(score as double)")
    score = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(1), F.least(F.lit(5), F.bround(number).cast("int"))))
    claims = F.filter(F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda c: F.coalesce(c, F.lit("")) != "")
    return replies.withColumn("score", score).withColumn("rationale", F.trim(F.coalesce("rationale", F.lit("")))).withColumn("claims", claims)


def review_flags(judged: DataFrame) -> DataFrame:
    """``flags`` of judgements to look at: nothing given, the criterion echoed as rationale, or full marks with unsupported claims."""
    asked = F.create_map(*[F.lit(x) for pair in CRITERIA.items() for x in pair])
    text, said = tx.collapse_statement(F.try_element_at(asked, F.col("criterion"))), tx.collapse_statement(F.col("rationale"))
    flags = F.array(
        F.when(F.col("score").isNull() & (F.col("rationale") == ""), F.lit("no_judgement")),
        F.when((F.length("rationale") >= 20) & F.contains(text, said), F.lit("rationale_repeats_criterion")),
        F.when((F.col("criterion") == "faithfulness") & (F.col("score") == 5) & (F.size("claims") > 0), F.lit("full_score_with_unsupported_claims")),
    )
    return judged.withColumn("flags", F.array_compact(flags))


def clean_rewrites(replies: DataFrame, *, max_queries: int = 3) -> DataFrame:
    """``(qid, question, queries)`` of ``(qid, question, replies array)``: trimmed, distinct whatever their case, capped; the question when none is left."""
    trimmed = F.filter(F.transform(F.coalesce("replies", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda q: F.coalesce(q, F.lit("")) != "")
    folded = F.transform(trimmed, lambda x: F.lower(x))
    first = F.filter(F.transform(trimmed, lambda q, i: F.when(F.array_position(folded, F.lower(q)) == i + 1, q)), lambda q: q.isNotNull())
    kept = F.slice(first, 1, max_queries)
    return replies.select("qid", "question", F.when(F.size(kept) > 0, kept).otherwise(F.array("question")).alias("queries"))
