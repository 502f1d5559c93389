"""Queries on readers and writers: tables are written in each format and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import models
from gleaner.operators import ranking
from gleaner.plans.registry import documents, query, table
from gleaner.plans.retrieval import BM25_ONE, QUESTION, RANKED, SHOW
from gleaner.results import Results
from gleaner.session import shared_folder, spread
from gleaner.sources import corpus as cp
from gleaner.sources.corpus import POSITION


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gleaner-files/{uuid.uuid4().hex}/{name}"


def _saved(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = _path(spark, name)
    cp.save_rows(rows, path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, lang FROM documents")
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return cp.from_file(spark, _saved(spark, rows, "documents.csv")).df.select("id", "text", "lang")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS text, c_mktsegment AS segment FROM customer")
def ingest_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("segment"))
    return cp.from_file(spark, _saved(spark, rows, "customers.tsv")).df.select("id", "text", "segment")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS text, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def ingest_jsonl_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions follow the files, which are written in the order of the key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text")).repartitionByRange(7, "id").sortWithinPartitions("id")
    return cp.from_file(spark, _saved(spark, rows, "orders.jsonl")).df.select("id", "text", F.col(POSITION).alias("pos"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)")
def ingest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of a reader: the first records of the file."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text")).repartitionByRange(7, "id").sortWithinPartitions("id")
    return cp.from_file(spark, _saved(spark, rows, "orders.parquet"), limit=1000).df.select("id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text, n_regionkey::BIGINT AS region FROM nation")
def ingest_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects that hold their records under a key, each of a bounded number of records and in a file of its own."""
    record = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), F.col("n_regionkey").alias("region"))
    parts = table(spark, sf_dir, "nation").groupBy(F.floor(F.col("n_nationkey") / 10).alias("part"))
    objects = parts.agg(F.to_json(F.struct(F.collect_list(record).alias("records"))).alias("value"))
    path = _path(spark, "nations.json")
    objects.write.partitionBy("part").text(path)
    return cp.from_file(spark, path).df.select("id", "text", F.col("region").cast("long").alias("region"))


@query("SELECT doc_id AS id, text, lang, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents WHERE lang IS NOT NULL AND doc_id >= 0")
def read_wrapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON files with their records under a key, decoded record by record, partitions of about 1 MB."""
    from gleaner.sources import wrapped

    path = _path(spark, "wrapped")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    wrapped.write(spread(rows), path)  # a file a task; only a small table is dealt first
    wrapped.register(spark)
    conditions = json.dumps([["lang", "null", False], ["id", ">=", 0]])
    back = spark.read.format("wrapped_json").schema("id long, text string, lang string").options(partitionBytes=1 << 20, where=conditions).load(path)
    return back.select("id", "text", "lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))


@query("""SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def stream_wrapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such files as a stream: one run takes the files of one language, the next, from its checkpoint, those that came since."""
    from gleaner.sources import wrapped

    path, out, progress = (_path(spark, name) for name in ("wrapped", "rows", "progress"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    wrapped.register(spark)
    for part in (rows.where("lang = 'en'"), rows.where("lang is distinct from 'en'")):
        wrapped.write(part, path, files=3)
        stream = spark.readStream.format("wrapped_json").schema(rows.schema).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, quality || '+' || toxic || '+it''s' AS tags FROM labels")
def ingest_list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are list literals, in JSON or in Python quoting, become arrays."""
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    cell = F.when(F.col("doc_id") % 2 == 0, F.format_string('["%s", "%s", "it\'s"]', q, t)).otherwise(F.format_string("['%s', '%s', \"it's\"]", q, t))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("x").alias("text"), cell.alias("tags"))
    return cp.from_file(spark, _saved(spark, rows, "labels.csv"), parse_lists=True).df.select("id", F.array_join("tags", "+").alias("tags"))


@query(f"{BM25_ONE}, {RANKED}, top AS (SELECT * FROM ranked WHERE rank <= 10) SELECT rank, doc_id, score, snippet FROM ({SHOW})")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as JSON lines and read again."""
    c = documents(spark, sf_dir)
    asked = ranking.questions(spark, [QUESTION])
    top = ranking.passages(ranking.top_k(ranking.bm25(ranking.index_for(c.texts(), asked), asked), 10), c, [])
    back = cp.read(spark, _saved(spark, top, "passages.jsonl"))
    return back.select(F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("doc_id"), "score", "snippet")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def embedding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("").alias("text"))
    corpus = cp.Corpus.of(rows, "vectors", order="id")
    path = _path(spark, "vectors.parquet")
    cp.save_embeddings(rows, path)
    back = cp.load_embeddings(corpus, path)
    return back.select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.size("embedding").alias("size"))


@query(f"{BM25_ONE}, {RANKED}, top AS (SELECT * FROM ranked WHERE rank <= 10) SELECT rank, doc_id, score FROM ({SHOW})")
def retrieve_from_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = documents(spark, sf_dir), _path(spark, "index")
    ranking.build_index(c.texts()).save(path)
    top = ranking.top_k(ranking.bm25(ranking.Index.load(spark, path), ranking.questions(spark, [QUESTION])), 10)
    return top.select(F.col("rank").cast("int").alias("rank"), F.col(POSITION).alias("doc_id"), F.round("score", 6).alias("score"))


def _files(rows: DataFrame) -> int:
    """Files for each batch of a stream made of a table, as many as a third of the table's splits, so that none grows with it."""
    return -(-rows.rdd.getNumPartitions() // 3)


@query("WITH d AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term")
def stream_index_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files: each batch adds its postings, and the tables are read as one index."""
    from gleaner.streaming.index import index, maintain

    folder, path = _path(spark, "in"), _path(spark, "index")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(POSITION), "text")
    files = _files(rows)
    rows.repartition(3 * files).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(folder)
    maintain(stream, path, _path(spark, "progress"), availableNow=True).awaitTermination()
    return index(spark, path).df


@query("""WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'changed ' || source ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 5 <> 0), w AS (SELECT regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') AS w FROM d)
SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term""")
def stream_changes_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of changes: all come, a third is replaced by other texts later, then a fifth is deleted."""
    from gleaner.streaming import changes

    folder, path, n = _path(spark, "in"), _path(spark, "index"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(n, n.alias(POSITION), "text", "source")
    files = _files(rows)
    # Later steps count, should a batch have files of two of them.
    change = lambda text, gone, at: [POSITION, text.alias("text"), F.lit(gone).alias("gone"), F.lit(at).cast("long").alias("at")]
    for step in (
        rows.select(*change(F.col("text"), False, 0)).repartition(3 * files),
        rows.where(n % 3 == 0).select(*change(F.concat(F.lit("changed "), F.col("source")), False, 1)).repartition(files),
        rows.where(n % 5 == 0).select(*change(F.lit(None).cast("string"), True, 2)).repartition(files),
    ):
        step.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(f"{POSITION} long, text string, gone boolean, at long").option("maxFilesPerTrigger", files).parquet(folder)
    changes.maintain(stream, path, _path(spark, "progress"), fan=2, availableNow=True).awaitTermination()
    return changes.index(spark, path, fan=2).df


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE doc_id IN (7, 3)")
def corpus_get_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).get([7, 100000000, 3], ["lang"]).select(F.col("doc_id").alias("id"), "lang")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"))


@query("""SELECT 'first' AS run, count(DISTINCT text) FILTER (WHERE lang = 'en') AS called, 0::BIGINT AS without FROM documents
UNION ALL SELECT 'second', (SELECT count(DISTINCT text) FROM documents) - (SELECT count(DISTINCT text) FROM documents WHERE lang = 'en'), 0 FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)
UNION ALL SELECT 'third', 0, 0 FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)""")
def embed_only_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept by content: a run over one language, one over all documents, which embeds only what is new, and one that finds everything."""
    texts = documents(spark, sf_dir).df.select(F.col(POSITION), "text", "lang")
    kept = Results(spark, _path(spark, "vectors"), "hashed words, 64", "array<float>")
    embedder = models.hashed_words(64)
    for run, rows in (("first", texts.where("lang = 'en'")), ("second", texts), ("third", texts)):
        kept.fill(rows, "text", lambda batch: list(embedder(batch)), run=run, waves=2)
    called = kept.rows().groupBy("run").agg(F.count("*").alias("called"))
    without = kept.joined(texts.where("text is not null"), "text", "embedding").agg(F.count_if(F.col("embedding").isNull()).alias("without"))  # one row
    runs = spark.createDataFrame([("first",), ("second",), ("third",)], "run string")
    return runs.join(called, "run", "left").select("run", F.coalesce("called", F.lit(0)).alias("called")).crossJoin(without)
