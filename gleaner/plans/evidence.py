"""Queries on chunks, curation, citations, samples and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import chunking, curation, evaluation
from gleaner.plans.registry import query, table


def _chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap
    block = f"(\\S+(?:\\s+\\S+){{0,{step - 1}}}\\s*)" if step > 1 else "(\\S+\\s*)"
    return f"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS n, length(regexp_extract(text, '^(\\s*)', 1)) AS lead, regexp_extract_all(text, '{block}') AS b FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, unnest(range(CAST(CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size}) / {step}::DOUBLE) + 1 END AS BIGINT))) AS k, CAST(CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size}) / {step}::DOUBLE) + 1 END AS INTEGER) AS c FROM d WHERE n > 0),
s AS (SELECT *, lead + coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0)::BIGINT AS st FROM k),
t AS (SELECT *, regexp_extract(substr(text, st + 1), '^(\\S+(?:\\s+\\S+){{0,{size - 1}}})', 1) AS chunk_text FROM s)
SELECT doc_id || '#' || k AS id, CAST(k AS INTEGER) AS chunk_index, c AS chunk_count, CAST(least(k * {step} + {size}, n) - k * {step} AS INTEGER) AS tokens,
CAST(k * {step} AS INTEGER) AS token_start, CAST(least(k * {step} + {size}, n) AS INTEGER) AS token_end, CAST(st AS INTEGER) AS char_start, CAST(st + length(chunk_text) AS INTEGER) AS char_end, chunk_text FROM t"""


SHOWN = ["id", "chunk_index", "chunk_count", "tokens", "token_start", "token_end", "char_start", "char_end", "chunk_text"]


def _chunks(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = chunking.chunk_spans(df, F.col("text"), size=size, overlap=overlap)
    return rows.withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")))


@query(_chunk_sql(200, 0))
def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 200, 0).select(*SHOWN)


@query(_chunk_sql(200, 40))
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 200, 40).select(*SHOWN)


@query(_chunk_sql(12, 4))
def chunk_small_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 12, 4).select(*SHOWN)


@query(f"WITH x AS ({_chunk_sql(200, 40)}) SELECT id, CASE WHEN trim(t) = '' THEN chunk_text ELSE trim(t) || chr(10) || chr(10) || chunk_text END AS text FROM x JOIN (SELECT doc_id, regexp_extract(text, '^\\s*([^.!?\\n]*)', 1) AS t FROM documents) d ON d.doc_id = CAST(split_part(id, '#', 1) AS BIGINT)")
def chunk_contextualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = table(spark, sf_dir, "documents").select("doc_id", "text", chunking.title_of(F.col("text")).alias("title"))
    rows = chunking.chunk_spans(titled, F.col("text"), size=200, overlap=40).drop("text")
    rows = chunking.with_context(rows, F.col("title"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), "text")


@query(f"WITH x AS ({_chunk_sql(200, 40)}) SELECT (SELECT count(*) FROM documents) AS articles, (SELECT count(*) FROM documents) - count(DISTINCT split_part(id, '#', 1)) AS empty_articles, count(*) AS chunks, min(tokens) AS min_tokens, median(tokens)::DOUBLE AS median_tokens, max(tokens) AS max_tokens FROM x")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, 200, 40).withColumn("source_id", F.col("doc_id"))
    return chunking.chunk_stats(table(spark, sf_dir, "documents"), chunks)


#: Sentences by a marker after their ends, since this engine has no lookbehind; then packed one after the other.
SENTENCES = """WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM s), w AS (SELECT *, len(regexp_extract_all(t, '\\S+')) AS n FROM u),
p AS (SELECT doc_id, i, t, n AS words, 0 AS k FROM w WHERE i = 1
UNION ALL SELECT w.doc_id, w.i, w.t, CASE WHEN p.words + w.n > 60 THEN w.n ELSE p.words + w.n END, CASE WHEN p.words + w.n > 60 THEN p.k + 1 ELSE p.k END FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1),
c AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY i) AS chunk_text FROM p GROUP BY doc_id, k)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_count, CAST(len(regexp_extract_all(chunk_text, '\\S+')) AS INTEGER) AS tokens, chunk_text FROM c"""


@query(SENTENCES)
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.sentence_chunks(df, F.col("text"), size=60).select("doc_id", "chunk_index", "chunk_count", "tokens", "chunk_text")


PASSAGES = "p AS (SELECT doc_id % 97 AS qid, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS rank, doc_id AS id, source AS source_id, text FROM documents)"
COLLAPSED = "replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
CURATED = f"""WITH {PASSAGES}, a AS (SELECT *, substr({COLLAPSED}, 1, 300) AS k FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY rank) AS copy FROM a WHERE k <> ''),
c AS (SELECT *, sum(CASE WHEN copy > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS dd FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY rank) AS nth FROM c WHERE copy = 1),
e AS (SELECT *, sum(CASE WHEN nth > {{cap}} THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS os FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM e WHERE nth <= {{cap}}),
g AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM f WHERE r <= 8)
SELECT qid, id, 'S' || r AS label, CAST({{at}} AS INTEGER) AS position, CAST(dd AS BIGINT) AS dropped_duplicates, CAST(os AS BIGINT) AS dropped_over_source_limit, CASE WHEN length(text) > 1500 THEN rtrim(substr(text, 1, 1500), ' ') || ' …' ELSE text END AS text FROM g"""
EDGES = "CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n - r // 2 + 1 END"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("qid"), F.col("doc_id").alias("id"), F.col("source").alias("source_id"), "text")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))


CURATE = ["qid", "id", "label", "position", "dropped_duplicates", "dropped_over_source_limit", "text"]


@query(CURATED.format(cap=1000000, at=EDGES))
def curate_edges_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(_passages(spark, sf_dir)).select(*CURATE)


@query(CURATED.format(cap=1000000, at="r"))
def curate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(_passages(spark, sf_dir), order="relevance").select(*CURATE)


@query(CURATED.format(cap=2, at=EDGES))
def curate_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(_passages(spark, sf_dir), max_per_source=2).select(*CURATE)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citations put in by a formula: after every full stop, and groups at the end."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = (F.col("conv_id") % 4 + 1).cast("string")
    cited = F.concat(F.replace("text", F.lit(". "), F.concat(F.lit(" [S"), n, F.lit("]. "))), F.lit(" [S1, G2] [ S9 ; S"), n, F.lit(" ]"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), cited.alias("answer"))


ANSWERS = "a AS (SELECT conv_id || '-' || turn AS qid, replace(text, '. ', ' [S' || (conv_id % 4 + 1) || ']. ') || ' [S1, G2] [ S9 ; S' || (conv_id % 4 + 1) || ' ]' AS answer FROM conversations WHERE role = 'assistant')"
LABELS = "list_transform(regexp_extract_all(array_to_string(regexp_extract_all(answer, '\\[\\s*[SG]\\d+(?:\\s*[,;]\\s*[SG]\\d+)*\\s*\\]'), ' '), '[SG]\\d+'), lambda x: x)"
FIRST = f"l AS (SELECT qid, unnest({LABELS}) AS c, generate_subscripts({LABELS}, 1) AS i FROM a), o AS (SELECT qid, c, min(i) AS i FROM l GROUP BY ALL)"


@query(f"WITH {ANSWERS}, {FIRST} SELECT qid, string_agg(c, ',' ORDER BY i) AS citations FROM o GROUP BY qid")
def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("qid", F.array_join(tx.extract_citations(F.col("answer")), ",").alias("citations"))


@query(f"WITH {ANSWERS}, {FIRST} SELECT qid, string_agg(c, ',' ORDER BY i) FILTER (WHERE c IN ('S1', 'S2', 'S3')) AS cited, string_agg(c, ',' ORDER BY i) FILTER (WHERE c NOT IN ('S1', 'S2', 'S3')) AS unknown, array_to_string(list_filter(['S1', 'S2', 'S3'], lambda x: NOT list_contains(list(c), x)), ',') AS uncited FROM o GROUP BY qid")
def citations_unknown_uncited(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = curation.citation_report(_answers(spark, sf_dir), F.array(*[F.lit(x) for x in ("S1", "S2", "S3")]))
    return told.select("qid", *[F.array_join(c, ",").alias(n) for c, n in (("cited", "cited"), ("unknown_citations", "unknown"), ("uncited_sources", "uncited"))])


GROUP = "\\[\\s*[SG]\\d+(?:\\s*[,;]\\s*[SG]\\d+)*\\s*\\]"
COVERAGE = f"""WITH {ANSWERS}, l AS (SELECT qid, trim(unnest(string_split(answer, chr(10)))) AS b, generate_subscripts(string_split(answer, chr(10)), 1) AS line FROM a),
h AS (SELECT *, max(CASE WHEN regexp_matches(trim(regexp_replace(regexp_replace(b, '^[*#_ ]+|[*#_ ]+$', '', 'g'), ':+$', '', 'g')), '(?i)^(?:sources?|references|bibliography)$') THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY line) AS over_ FROM l),
k AS (SELECT qid, line, string_split(regexp_replace(b, '([.!?]["''”’)\\]]?)\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM h WHERE over_ = 0 AND NOT regexp_matches(b, '^#') AND NOT regexp_matches(b, '^(?:[-*]\\s*)?\\[\\s*[SG]\\d+')),
p AS (SELECT qid, line, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM k),
f AS (SELECT *, regexp_matches(regexp_replace(part, '{GROUP}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]') AS word, regexp_matches(part, '{GROUP}') AS cite FROM p),
n AS (SELECT *, sum(word::INT) OVER (PARTITION BY qid, line ORDER BY i) AS st FROM f),
g AS (SELECT qid, line, st, max(cite::INT) AS cite FROM n WHERE st > 0 GROUP BY ALL), t AS (SELECT qid, count(*) AS statements, CAST(sum(cite) AS BIGINT) AS cited_statements FROM g GROUP BY qid)
SELECT qid, coalesce(statements, 0) AS statements, coalesce(cited_statements, 0) AS cited_statements, round_even(cited_statements / statements::DOUBLE, 3) AS coverage FROM a LEFT JOIN t USING (qid)"""


@query(COVERAGE)
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.citation_coverage(_answers(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE length(text) >= 500 ORDER BY md5(doc_id || ':7') LIMIT 20")
def sample_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return evaluation.sample(d, F.col("doc_id"), F.col("text"), size=20, seed=7).select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7')) AS n FROM documents) WHERE n <= 3")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return evaluation.sample_stratified(d, F.col("doc_id"), F.col("source"), per_stratum=3, seed=7).select("doc_id", "source")


#: Ways of asking, of which an order takes one by its key; {} is a word of the order.
WAYS = ["What changed since {}?", "What may happen to {} in May?", "Sales of {} in Q3 2024", "Who wrote this article on {}?", "How do budgets of {} compare before 2020?", "past 3 months of {}", "Is {} the passage meant?", "who is {}"]
PERIOD_SQL = r"\b((19|20)[0-9]{2}|q[1-4]|january|february|march|april|june|july|august|september|october|november|december|since|until|before|after|between|during|(last|this|past|previous)\s+([0-9]+\s+)?(day|week|month|quarter|year)s?)\b"
SOURCE_SQL = r"\b(this|the|that)\s+(article|text|passage|document|report|piece|story|excerpt)\b"


@query(f"WITH q AS (SELECT o_orderkey AS qid, replace(list_extract({WAYS}, CAST(o_orderkey % 8 + 1 AS BIGINT)), '{{}}', CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END) AS question FROM orders) SELECT qid, question, regexp_matches(lower(question), '{PERIOD_SQL}') AS period, regexp_matches(lower(question), '{SOURCE_SQL}') AS points FROM q")
def question_names_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every order: whether it names a period, and whether it points at its source."""
    n = F.col("o_orderkey")
    word = F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    way = F.element_at(F.array(*[F.lit(w) for w in WAYS]), (n % 8 + 1).cast("int"))
    q = table(spark, sf_dir, "orders").select(n.alias("qid"), F.replace(way, F.lit("{}"), word).alias("question"))
    return q.select("qid", "question", tx.names_a_period(F.col("question")).alias("period"), tx.points_at_source(F.col("question")).alias("points"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 2 = 0 THEN ' ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority END AS t FROM orders),
u AS (SELECT o_custkey, trim(t) AS t, o_orderkey FROM l WHERE trim(t) <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(trim(t)) ORDER BY o_orderkey) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM u)
SELECT o_custkey AS qid, coalesce(string_agg(t, ',' ORDER BY n) FILTER (WHERE n <= 3), 'of ' || o_custkey) AS queries FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN k USING (o_custkey) GROUP BY o_custkey""")
def clean_query_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the phrasings that a model replied: blank ones, repeats in another case, too many."""
    n, p = F.col("o_orderkey"), F.col("o_orderpriority")
    said = F.when(n % 5 == 0, F.lit("  ")).when(n % 2 == 0, F.concat(F.lit(" "), F.lower(p), F.lit(" "))).otherwise(p)
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), said.alias("t")))).alias("r"))
    replies = each.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("of "), F.col("o_custkey").cast("string")).alias("question"), F.col("r.t").alias("replies"))
    return evaluation.clean_rewrites(replies).select("qid", F.array_join("queries", ",").alias("queries"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE greatest(1, least(5, CAST(doc_id % 9 - 1 AS INTEGER))) END AS score, CASE WHEN doc_id % 7 = 0 THEN 'no_judgement' WHEN doc_id % 9 - 1 >= 5 AND doc_id % 2 = 1 THEN 'full_score_with_unsupported_claims' ELSE '' END AS flags FROM labels")
def judge_clean_and_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    replies = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("faithfulness").alias("criterion"), F.when(n % 7 == 0, F.lit("n/a")).otherwise((n % 9 - 1).cast("string")).alias("score"),
        F.when(n % 7 == 0, F.lit(" ")).otherwise(F.lit("said so")).alias("rationale"), F.when(n % 2 == 1, F.array(F.lit(" a claim "), F.lit(" "))).alias("claims"),
    )
    return evaluation.review_flags(evaluation.clean_judgements(replies)).select("doc_id", "score", F.array_join("flags", ",").alias("flags"))


LINKS = "CASE s WHEN 'S1' THEN '(http://a/1)' WHEN 'S3' THEN '(http://a/3)' ELSE '' END"


@query(f"""WITH {ANSWERS}, g AS (SELECT qid, string_split_regex(answer, '{GROUP}') AS gaps, regexp_extract_all(answer, '{GROUP}') AS gs FROM a)
SELECT qid, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(array_to_string(list_transform(regexp_extract_all(gs[i], '[SG]\\d+'), lambda s: '[' || s || ']' || {LINKS}), ''), '')), '') AS linked FROM g""")
def link_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.create_map(F.lit("S1"), F.lit("http://a/1"), F.lit("S3"), F.lit("http://a/3"))
    return _answers(spark, sf_dir).select("qid", tx.link_citations(F.col("answer"), urls).alias("linked"))


@query(f"""WITH c AS ({CURATED.format(cap=2, at=EDGES)}) SELECT qid, 'Question: What is in ' || qid || '?' || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY position)
|| chr(10) || chr(10) || 'Instructions: Be brief.' || chr(10) || chr(10) || 'Answer the question and cite the sources and facts used by their labels.' AS prompt FROM c GROUP BY qid""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = curation.curate(_passages(spark, sf_dir), max_per_source=2)
    asked = curated.select("qid").distinct().withColumn("question", F.concat(F.lit("What is in "), F.col("qid").cast("string"), F.lit("?")))
    return curation.prompts(curated, asked, instructions="Be brief.")


@query("SELECT doc_id, trim(regexp_replace('<think>' || substr(text, 1, 40) || '</think> ' || lang || ' <think>' || chr(10) || '</think>', '(?s)<think>.*?</think>', '', 'g')) AS said FROM documents")
def strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("<think>"), F.substring("text", 1, 40), F.lit("</think> "), F.col("lang"), F.lit(" <think>\n</think>"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_reasoning(said).alias("said"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) JOIN range(50) t(j) ON i = (j * n) // 50")
def sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return evaluation.even_sample(d, ["n_chars", "doc_id"], 50).select("doc_id")


TYPES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(evaluation.QUESTION_TYPES))


@query(f"SELECT type, count(item_id) AS n FROM (VALUES {TYPES}) v(i, type) LEFT JOIN benchmark ON item_id % 7 = i GROUP BY type")
def question_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in evaluation.QUESTION_TYPES])
    asked = table(spark, sf_dir, "benchmark").select(F.get(types, (F.col("item_id") % 7).cast("int")).alias("type"))
    return evaluation.type_counts(asked)


@query("""WITH r AS (SELECT doc_id % 50 AS record, doc_id AS place, 'Who is ' || lang || '?' AS question, source AS answer, CASE WHEN doc_id % 2 = 0 THEN 'factual' END AS type FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY record, lower(question) ORDER BY place) = 1), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY record ORDER BY place) <= 2)
SELECT record, question, answer, type, 'q' || row_number() OVER (ORDER BY record, place) AS qid FROM p""")
def clean_test_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with questions that are blank, that point at their article, or that come twice."""
    n = F.col("doc_id")
    question = F.when(n % 11 == 0, "What does this article say?").when(n % 7 == 0, "  ").otherwise(F.concat(F.lit(" Who is "), F.when(n % 3 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("? ")))
    replies = table(spark, sf_dir, "documents").select(
        (n % 50).alias("record"), n.alias("at"), question.alias("question"), F.col("source").alias("answer"), F.when(n % 2 == 0, "factual").otherwise("odd").alias("type")
    )
    cleaned = evaluation.clean_questions(replies, per_record=2)
    return cleaned.select("record", F.concat(F.lit("Who is "), F.lower(F.regexp_extract("question", r"^Who is (.*)\?$", 1)), F.lit("?")).alias("question"), "answer", "type", "qid")
