"""Queries on the task types that are contracts only, memory lineage and event time: designs of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import tasks
from gleaner.operators.resolution import resolve_names
from gleaner.plans.registry import documents, query, table

DATE = "(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER))"


@query(f"SELECT substr(CAST({DATE} AS VARCHAR), 1, 7) AS month, count(*) AS n FROM documents GROUP BY 1")
def aggregate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.aggregate_by_month(documents(spark, sf_dir).df, F.col("date"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def aggregate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_type, day, n, lag(n) OVER w AS previous, n - lag(n) OVER w AS difference, round(n / lag(n) OVER w::DOUBLE, 6) AS ratio FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def compare_period_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return tasks.compare_with_previous(e, ["event_type"], "day", "n").withColumn("ratio", F.round("ratio", 6))


@query("SELECT c_custkey, c_mktsegment, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS percentile, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS above_mean FROM customer")
def benchmark_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tasks.benchmark_percentile(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return b.select("c_custkey", "c_mktsegment", F.round("percentile", 6).alias("percentile"), F.round("above_mean", 6).alias("above_mean"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS label FROM orders")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("large", F.col("o_totalprice") > 200000), ("urgent", F.col("o_orderpriority").like("1%"))]
    return tasks.classify(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "label")


@query("SELECT doc_id, 'email' AS detector, unnest(m) AS evidence, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS at FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+') AS m FROM documents)")
def detect_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"})
    return found.select("doc_id", "detector", "evidence", "at")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss') AS k FROM documents) GROUP BY k")
def deduplicate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.deduplicate_exact(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "copies")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))), ' ') AS k FROM documents) GROUP BY k")
def deduplicate_same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.deduplicate_same_words(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "copies")


@query("""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda x: hash(x))) AS w FROM documents),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id <> b.doc_id AND 10 * least(len(a.w), len(b.w)) >= 8 * greatest(len(a.w), len(b.w))
AND (len(a.w) = 0 OR 10 * len(list_intersect(a.w, b.w)) >= 8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))),
r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON r.doc_id = e.a), c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT m AS doc_id, count(*) AS copies FROM c GROUP BY m""")
def deduplicate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brute force in SQL: every pair of documents whose sizes allow it."""
    return tasks.deduplicate_near(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "copies")


@query("SELECT min(c_name) OVER (PARTITION BY lower(substr(c_name, 1, 16))) AS canonical, c_custkey, c_name FROM customer")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.resolve_entities(table(spark, sf_dir, "customer"), "c_name", F.lower(F.substring("c_name", 1, 16))).select("canonical", "c_custkey", "c_name")


@query("""WITH RECURSIVE m AS (SELECT p_partkey, p_name AS w, CAST(p_partkey // 4 % length(p_name) AS BIGINT) AS i FROM part),
p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN w WHEN 1 THEN upper(w) WHEN 2 THEN substr(w, 1, i) || substr(w, i + 2) ELSE substr(w, 1, i) || 'x' || substr(w, i + 2) END AS name FROM m),
k AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS k FROM p), c AS (SELECT k, name, count(*) AS n FROM k GROUP BY ALL), d AS MATERIALIZED (SELECT k, min((-n, name)) AS best FROM c GROUP BY k),
e AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON a.k <> b.k AND abs(length(a.k) - length(b.k)) <= 1 AND levenshtein(a.k, b.k) <= 1),
r AS (SELECT k, k AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON r.k = e.a), o AS (SELECT k, min(m) AS root FROM r GROUP BY k), z AS (SELECT root, min(best)[2] AS canonical FROM o JOIN d USING (k) GROUP BY root)
SELECT p_partkey, name, canonical FROM k JOIN o USING (k) JOIN z USING (root)""")
def resolve_misspelt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, a quarter in capitals, a quarter without a letter and a quarter with a wrong one."""
    n, w = F.col("p_partkey"), F.col("p_name")
    i = (F.floor(n / 4) % F.length(w)).cast("int")
    head, tail = F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))
    name = F.when(n % 4 == 0, w).when(n % 4 == 1, F.upper(w)).when(n % 4 == 2, F.concat(head, tail)).otherwise(F.concat(head, F.lit("x"), tail))
    return resolve_names(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name")


@query("""WITH l AS (SELECT doc_id, source, i, line FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT source, trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3), k AS (SELECT l.* FROM l LEFT JOIN c ON l.source = c.source AND trim(l.line) = c.t WHERE c.t IS NULL)
SELECT d.doc_id, d.source, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.source""")
def clean_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.clean_boilerplate(table(spark, sf_dir, "documents"), "doc_id", "source", "text", least=3)


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1)), '') AS page_lang FROM pages")
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.parse_pages(table(spark, sf_dir, "pages"), "html").select("page_id", "title", "page_lang")


BODY = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"


@query(f"SELECT page_id, trim({BODY}) AS body FROM pages")
def parse_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.parse_pages(table(spark, sf_dir, "pages"), "html").select("page_id", "body")


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE 'unknown' END AS quality FROM labels")
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.normalize_codes(table(spark, sf_dir, "labels"), "quality", {"1": "good", "0": "poor"}).select("doc_id", "quality")


@query("SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def enrich_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return tasks.enrich(orders, customer, F.col("o_custkey") == F.col("c_custkey"), ["c_name"]).select("o_orderkey", "c_name", "matched")


@query("SELECT 'price_positive' AS rule, count(*) FILTER (WHERE l_extendedprice > 0) AS passed, count(*) FILTER (WHERE NOT l_extendedprice > 0) AS failed FROM lineitem UNION ALL SELECT 'discount_small', count(*) FILTER (WHERE l_discount < 0.05), count(*) FILTER (WHERE NOT l_discount < 0.05) FROM lineitem")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.validate(table(spark, sf_dir, "lineitem"), {"price_positive": F.col("l_extendedprice") > 0, "discount_small": F.col("l_discount") < 0.05})


TRACK = "(inea|tionnd)"


@query(f"WITH d AS (SELECT doc_id, regexp_extract(text, '^\\s*([^.!?\\n]*)', 1) AS t, text FROM documents) SELECT doc_id FROM d WHERE regexp_matches(lower(t), '{TRACK}') OR len(regexp_extract_all(lower(t || ' ' || text), '{TRACK}')) >= 2")
def select_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return tasks.select_track(d, TRACK, F.regexp_extract("text", r"^\s*([^.!?\n]*)", 1), F.col("text")).select("doc_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.streaming.windows import hourly

    e = table(spark, sf_dir, "events")
    return hourly(e).select("start", "event_type", "n", F.round("total", 4).alias("total"))


DERIVED = "r AS (SELECT 'rows_' || o_orderkey AS handle, o_orderstatus AS object_type, o_orderkey AS created, 'rows_' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)"


def _recordsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recordset for every order, derived from the same customer's order before."""
    n = F.col("o_orderkey")
    named = F.concat(F.lit("rows_"), n.cast("string")).alias("handle")
    before = F.concat(F.lit("rows_"), F.lag(n).over(Window.partitionBy("o_custkey").orderBy(n)).cast("string")).alias("parent")
    return table(spark, sf_dir, "orders").select(named, F.col("o_orderstatus").alias("object_type"), n.alias("created"), before)


@query(f"WITH RECURSIVE {DERIVED}, a AS (SELECT handle, parent AS ancestor, 1 AS distance FROM r WHERE parent IS NOT NULL UNION ALL SELECT a.handle, r.parent, a.distance + 1 FROM a JOIN r ON r.handle = a.ancestor WHERE r.parent IS NOT NULL) SELECT * FROM a")
def recordset_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.memory.catalog import lineage_table

    return lineage_table(_recordsets(spark, sf_dir))


@query(f"WITH {DERIVED} SELECT object_type, arg_max(handle, created) AS handle FROM r GROUP BY object_type")
def recordset_newest_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recordsets(spark, sf_dir).groupBy("object_type").agg(F.max_by("handle", "created").alias("handle"))
