import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import curation, evaluation, reranking

PASSAGES = "qid int, rank int, id string, source_id string, text string"


def test_curation_counts_and_orders(spark):
    rows = [(0, 1, "a", "s", "same  Text"), (0, 2, "b", "s", "same text"), (0, 3, "c", "s", " "), (0, 4, "d", "s", "other"), (0, 5, "e", None, "third"), (0, 6, "f", "t", "x" * 30)]
    got = curation.curate(spark.createDataFrame(rows, PASSAGES), max_per_source=1, max_chars=10).orderBy("position").collect()
    assert [(r.id, r.label, r.position) for r in got] == [("a", "S1", 1), ("f", "S3", 2), ("e", "S2", 3)]
    assert {(r.dropped_duplicates, r.dropped_over_source_limit) for r in got} == {(1, 1)} and got[1].text == "x" * 10 + " …"
    with pytest.raises(ValueError):
        curation.curate(spark.createDataFrame(rows, PASSAGES), order="odd")


@pytest.mark.parametrize("n", range(1, 10))
def test_best_passages_stand_at_the_edges(spark, n):
    rows = [(0, i + 1, str(i), None, f"text {i}") for i in range(n)]
    got = curation.curate(spark.createDataFrame(rows, PASSAGES), max_passages=n).orderBy("position").collect()
    odd, even = list(range(1, n + 1, 2)), list(range(2, n + 1, 2))
    assert [r.rank for r in got] == odd + even[::-1]


COVERAGE = {
    "A. [S1] B [S2]. C": (3, 1), "# Head\nA one [S1].\n[S1] Title": (1, 1), "Only. Words!": (2, 0), "[S1]": (0, 0), "A.\n[S1]": (1, 0), "": (0, 0),
    'He said "yes." Then left [G1].\n**Sources:**\nA [S1].': (2, 1), "- [S1] entry\nA [S1].": (1, 1),
}


def test_citation_coverage(spark):
    rows = list(enumerate(COVERAGE))
    got = curation.citation_coverage(spark.createDataFrame(rows, "qid int, answer string")).collect()
    assert {rows[r.qid][1]: (r.statements, r.cited_statements) for r in got} == COVERAGE
    assert all((r.coverage is None) == (r.statements == 0) for r in got)


def test_rerank_walk_equals_a_loop(spark):
    random.seed(1)
    rows, want = [], {}
    for q in range(40):
        n, keep, cap = random.randint(1, 12), 4, 2
        cands = [(q, "q", i + 1, f"{q}-{i}", random.choice("abc"), str(random.randint(0, 5))) for i in range(n)]
        rows += cands
        used, kept, skipped = {}, [], 0
        for c in sorted(cands, key=lambda c: (-float(c[5]), c[2])):
            if len(kept) == keep:
                break
            if used.get(c[4], 0) >= cap:
                skipped += 1
                continue
            used[c[4]] = used.get(c[4], 0) + 1
            kept.append(c[3])
        want[q] = (kept, skipped)
    df = spark.createDataFrame(rows, "qid int, question string, retrieval_rank int, id string, source_id string, text string")
    got = reranking.rerank(df, scorer=lambda q, t: t.cast("double"), keep=4, max_per_source=2).orderBy("qid", "rank").collect()
    for q, (kept, skipped) in want.items():
        mine = [r for r in got if r.qid == q]
        assert [r.id for r in mine] == kept and {r.skipped_over_source_limit for r in mine} == {skipped}
        assert all(r.rank_change == r.retrieval_rank - r["rank"] for r in mine)


def test_model_reranker_must_score_every_text(spark):
    df = spark.createDataFrame([(0, "q", 1, "a", None, "x y"), (0, "q", 2, "b", None, "x")], "qid int, question string, retrieval_rank int, id string, source_id string, text string")
    good = reranking.rerank(df, scorer=reranking.model_score(lambda q, ts: [-len(t) for t in ts])).orderBy("rank").collect()
    assert [r.id for r in good] == ["b", "a"]
    with pytest.raises(Exception, match="scores for"):
        reranking.rerank(df.coalesce(1), scorer=reranking.model_score(lambda q, ts: [])).collect()


def test_metrics(spark):
    asked = spark.createDataFrame([(0,), (1,), (2,)], "qid int")
    runs = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (1, 1, "z")], "qid int, rank int, id string")
    rel = spark.createDataFrame([(0, "b"), (0, "b"), (0, "c"), (2, "x")], "qid int, id string")
    got = {r.qid: r for r in evaluation.retrieval_metrics(asked, runs, rel, ks=[1, 2]).collect()}
    assert (got[0].precision_at_1, got[0].precision_at_2, got[0].recall_at_2, got[0].reciprocal_rank) == (0.0, 0.5, 0.5, 0.5)
    assert got[1].recall_at_1 is None and got[2].recall_at_1 == 0.0 and got[2].hit_at_2 == 0.0
    mean = evaluation.metric_means(evaluation.retrieval_metrics(asked, runs, rel, ks=2)).first()
    assert (mean.questions, mean.recall_at_2, mean.mrr) == (3, 0.25, 0.1667)
    deep = {r.qid: r for r in evaluation.average_precision(runs, rel).collect()}
    assert deep[0].average_precision == 0.25 and deep[0].r_precision == 0.5 and deep[2].ndcg == 0
    with pytest.raises(ValueError):
        evaluation.retrieval_metrics(asked, runs, rel, ks=[0])


def test_questions_are_cleaned(spark):
    rows = [(0, 0, "What does this article say?", "a", "factual"), (0, 1, " Who? ", "b", "odd"), (0, 2, "who?", "c", "factual"), (0, 3, "", "d", None), (1, 0, "When?", "e", "temporal")]
    got = evaluation.clean_questions(spark.createDataFrame(rows, "record int, at int, question string, answer string, type string"), per_record=2).orderBy("qid").collect()
    assert [(r.qid, r.question, r.type) for r in got] == [("q1", "Who?", None), ("q2", "When?", "temporal")]
    assert {r.type: r.n for r in evaluation.type_counts(spark.createDataFrame([("temporal",)], "type string")).collect()}["factual"] == 0


def test_even_sample_spreads_over_the_order(spark):
    got = [r.id for r in evaluation.even_sample(spark.range(10), ["id"], 4).orderBy("id").collect()]
    assert got == [int(i * 10 / 4) for i in range(4)]


def test_judgements(spark):
    echo = evaluation.CRITERIA["relevance"]
    rows = [("faithfulness", "9", "fine", [" c ", ""]), ("relevance", "2.5", echo, None), ("completeness", "bad", None, None)]
    got = {r.criterion: r for r in evaluation.review_flags(evaluation.clean_judgements(spark.createDataFrame(rows, "criterion string, score string, rationale string, claims array<string>"))).collect()}
    assert (got["faithfulness"].score, got["faithfulness"].claims, got["faithfulness"].flags) == (5, ["c"], ["full_score_with_unsupported_claims"])
    assert (got["relevance"].score, got["relevance"].flags) == (2, ["rationale_repeats_criterion"])
    assert got["completeness"].flags == ["no_judgement"]


def test_prompt_has_sources_in_position_and_facts(spark):
    rows = [(0, i + 1, str(i), None, f"body {i}") for i in range(3)]
    curated = curation.curate(spark.createDataFrame(rows, PASSAGES)).withColumn("title", F.lit("T"))
    asked = spark.createDataFrame([(0, "why?")], "qid int, question string")
    text = curation.prompts(curated, asked, None, "be brief").first().prompt
    assert text.startswith("Question: why?") and text.index("[S1] T\nbody 0") < text.index("[S3] T\nbody 2") < text.index("[S2] T\nbody 1") and "be brief" in text
