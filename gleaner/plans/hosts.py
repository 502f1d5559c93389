"""Queries through what a host calls: tools, their arguments and results, recordset memory, replies of models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import models
from gleaner.memory.commits import CommitLogStore
from gleaner.memory.facade import Memory
from gleaner.memory.oplog import VERBOSE, ListSink, OpLog
from gleaner.memory.policy import DefaultPolicy, human_bytes
from gleaner.memory.records import value_ref
from gleaner.plans.evidence import _chunk_sql
from gleaner.plans.registry import documents, query, table
from gleaner.plans.retrieval import BM25_ONE, QUESTION, RANKED, SHOW
from gleaner.session import shared_folder
from gleaner.sources import corpus as cp


def _values(rows: list[tuple], names: str) -> str:
    """SQL for a literal table."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names})"


def _context(spark: SparkSession, sf_dir: str, name: str) -> tuple[Any, str]:
    from gleaner.tools.framework import ToolContext

    corpus = documents(spark, sf_dir)
    cp.register_corpus(cp.Corpus(corpus.df, name, corpus.id_field, corpus.text_field))
    return ToolContext(spark=spark), name


@query(f"{BM25_ONE}, {RANKED}, top AS (SELECT * FROM ranked WHERE rank <= 10) SELECT rank, CAST(doc_id AS VARCHAR) AS id, score FROM ({SHOW})")
def tool_retrieve_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.tools.shipped import RetrievePassagesTool

    context, name = _context(spark, sf_dir, "tool_documents")
    found = RetrievePassagesTool().run({"query": QUESTION, "corpus": name}, context=context)
    return found["frame"].select(F.col("rank").cast("int").alias("rank"), "id", "score")


@query(f"WITH x AS ({_chunk_sql(200, 40)}) SELECT id, chunk_index, tokens, chunk_text AS text FROM x")
def tool_chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.tools.shipped import ChunkBySizeTool

    context, name = _context(spark, sf_dir, "tool_documents")
    return ChunkBySizeTool().run({"corpus": name, "size": 200, "overlap": 40}, context=context)["frame"].select("id", "chunk_index", "tokens", "text")


@query("SELECT 'q' || (item_id + 1) AS id, CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision_at_1, 1.0::DOUBLE AS recall_at_2, CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS reciprocal_rank FROM benchmark")
def tool_calculate_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question whose relevant id was found first or second."""
    from gleaner.tools.framework import ToolContext
    from gleaner.tools.shipped import CalculateRetrievalMetricsTool

    items = [r.item_id for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]  # the tool takes a list from its caller
    asked = [{"id": f"q{i + 1}", "relevant": [str(i)], "retrieved": [str(i), "x"] if i % 2 == 0 else ["x", {"id": f"{i}#4", "source_id": str(i)}]} for i in items]
    rows = CalculateRetrievalMetricsTool().run({"items": asked, "k": [1, 2]}, context=ToolContext(spark=spark))["rows"]
    return spark.createDataFrame([(r["id"], r["precision_at_1"], r["recall_at_2"], r["reciprocal_rank"]) for r in rows], "id string, precision_at_1 double, recall_at_2 double, reciprocal_rank double")


ANSWER = "One thing [S1]. Another [S9, S2]. A third."


@query(_values([("answer", ANSWER), ("cited", "S1,S2"), ("unknown_citations", "S9"), ("uncited_sources", "S3"), ("coverage", "0.667"), ("linked", "One thing [S1](http://a/1). Another [S9][S2](http://a/2). A third.")], "name, value"))
def tool_synthesize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a scripted model over three documents, with its citations checked and linked."""
    from gleaner.tools.framework import ToolContext
    from gleaner.tools.shipped import SynthesizeAnswerTool

    class Scripted(SynthesizeAnswerTool):
        def generate(self, system: str, user: str, settings: dict[str, Any], context: ToolContext) -> str:
            return ANSWER

    texts = [r.text for r in table(spark, sf_dir, "documents").where("doc_id in (1, 2, 3)").orderBy("doc_id").collect()]
    passages = [{"id": str(i), "text": t, "url": f"http://a/{i}"} for i, t in enumerate(texts, 1)]
    out = Scripted().run({"question": "What is there?", "passages": passages, "model": "scripted"}, context=ToolContext(spark=spark))
    listed = {n: ",".join(out[n]) for n in ("cited", "unknown_citations", "uncited_sources")}
    told = {"answer": out["answer"], **listed, "coverage": str(out["coverage"]), "linked": out["answer_markdown"]}
    return spark.createDataFrame(list(told.items()), "name string, value string")


CASES: list[tuple[str, Any, str]] = [
    ("not an object", [], "invalid_arguments"), ("nothing", {}, "missing_required_arguments"), ("blank", {"query": " "}, "invalid_argument_value"),
    ("wrong type", {"query": "x", "size": True}, "invalid_argument_type"), ("empty list", {"query": "x", "queries": []}, "invalid_argument_value"),
    ("blank in list", {"query": "x", "queries": [""]}, "invalid_argument_value"), ("null is left out", {"query": "x", "size": None, "other": 1}, "ok"),
]


@query("SELECT c_custkey, list_extract([" + ", ".join(f"'{code}'" for _, _, code in CASES) + f"], CAST(c_custkey % {len(CASES)} + 1 AS BIGINT)) AS outcome FROM customer")
def tool_argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments for every customer, one of the cases by its key, checked where the rows are."""
    def outcome(args: Any) -> str:
        from gleaner.tools.framework import ToolInputError, validate_tool_args
        from gleaner.tools.shipped import RetrievePassagesTool

        try:
            validate_tool_args(args, RetrievePassagesTool().schema)
        except ToolInputError as error:
            return json.loads(error.to_result())["error"]["code"]
        return "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [outcome(json.loads(args)) for args in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["c_custkey", "outcome"])

    sent = F.element_at(F.array(*[F.lit(json.dumps(args)) for _, args, _ in CASES]), (F.col("c_custkey") % len(CASES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", sent.alias("sent")).mapInArrow(run, "c_custkey long, outcome string")


#: Stages of the registered tools, in the order of stage and name.
STAGES = ["analyze"] * 2 + ["enrich", "extract"] + ["gather"] * 5 + ["preprocess", "unknown"]


@query(f"SELECT list_extract({STAGES}, CAST(o_orderkey % {len(STAGES)} + 1 AS BIGINT)) AS stage, count(*) AS asked FROM orders GROUP BY 1")
def tools_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for a tool each; the registry says to which stage it belongs."""
    from gleaner.tools import registry

    registry.register_reference_tools(registry="query")
    named = [(stage, name) for stage, names in sorted(registry.tools_by_stage("query").items()) for name in sorted(names)]
    registry.clear_registry("query")
    tools = spark.createDataFrame([(i, stage, name) for i, (stage, name) in enumerate(named)], "at long, stage string, tool string")  # the registry's few rows
    asked = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % len(named)).alias("at")).agg(F.count("*").alias("n"))
    return asked.join(tools, "at").groupBy("stage").agg(F.sum("n").alias("asked"))


@query("SELECT 'rows_' || (r_regionkey + 1) AS handle, r_regionkey + 1 AS n, CASE WHEN r_regionkey > 0 THEN 'rows_' || r_regionkey END AS parent, r_regionkey < (SELECT max(r_regionkey) FROM region) - 1 AS tombstoned FROM region")
def recordset_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recordset for every region, each derived from the one before; the policy keeps two, the others leave their metadata."""
    memory = Memory(policy=DefaultPolicy(max_per_object_type=2), session_id="s")
    parents: list[str] = []
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        made = memory.remember(object_type="rows", stage="gather", produced_by="query", ref=value_ref([r.r_name] * (r.r_regionkey + 1)), derived_from=parents)
        parents = [made.handle]
    memory.compact()
    rows = [(r.handle, r.count, r.derived_from[0] if r.derived_from else None, r.tombstoned) for r in memory.list(include_tombstoned=True)]
    return spark.createDataFrame(rows, "handle string, n int, parent string, tombstoned boolean")


@query("""SELECT op, CASE op WHEN 'write' THEN (SELECT count(*) FROM region) + 1 ELSE 1 END AS n FROM (VALUES ('bind'), ('bind_failed'), ('digest'), ('purge'), ('read'), ('turn_summary'), ('write')) v(op)""")
def recordset_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log of one turn says: a recordset for every region and an empty one, one bound and read, a failed request, one purged."""
    from gleaner.tools.framework import ToolInputError

    sink = ListSink()
    memory = Memory(session_id="s", oplog=OpLog(sink, level=VERBOSE))
    made = [memory.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([r.r_name])) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    memory.remember(object_type="rows", stage="gather", produced_by="p", ref=value_ref([]))
    memory.records(memory.bind(object_type="rows", tool_name="t"))
    try:
        memory.bind(object_type="other", tool_name="t")
    except ToolInputError:
        pass
    memory.digest()
    memory.purge(made[0].handle)
    memory.end_turn()
    return spark.createDataFrame([(op,) for op in sink.ops()], "op string").groupBy("op").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus)
SELECT 'orders_' || k AS handle, n, CASE WHEN k > 1 THEN 'orders_' || (k - 1) END AS parent, total FROM s WHERE k <> 2""")
def recordset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each status as a stored recordset: written by Spark, named in a commit log, one purged, read back from the log."""
    store = CommitLogStore(spark, f"{shared_folder(spark)}/recordsets-{uuid.uuid4().hex}")
    memory, orders = Memory(store, session_id="s"), table(spark, sf_dir, "orders")
    made: list[str] = []
    for status in sorted(r.o_orderstatus for r in orders.select("o_orderstatus").distinct().collect()):  # a few codes
        ref, n = store.put_rows(orders.where(F.col("o_orderstatus") == status))
        made.append(memory.remember(object_type="orders", stage="gather", produced_by="query", ref=ref, count=n, derived_from=made[-1:]).handle)
    store.delete(made[1], owner="session:s")
    told = store.table().select("handle", "n", F.get("parents", F.lit(0)).alias("parent"))
    sums = [store.rows(r).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(r.handle).alias("handle"), "total") for r in memory.list()]
    return told.join(reduce(DataFrame.unionByName, sums), "handle")


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS phrase
FROM (SELECT o_orderkey, CAST(floor(pow(1.7::DOUBLE, o_orderkey % 45)) AS DOUBLE) AS b FROM orders)""")
def memory_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size for every order, said in words where the rows are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([human_bytes(b) for b in batch.column(1).to_pylist()], pa.string())], ["o_orderkey", "phrase"])

    size = F.floor(F.pow(F.lit(1.7), F.col("o_orderkey") % 45)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("b")).mapInArrow(run, "o_orderkey long, phrase string")


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN lang END AS lang, CASE WHEN doc_id % 5 < 4 THEN n_chars END AS n FROM documents")
def parse_json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for every document: bare JSON, fenced after a thought, inside prose, in the second of two blocks, or none."""
    value, n = F.to_json(F.struct("lang", F.col("n_chars").alias("n"), F.struct(F.lit("a { b").alias("text")).alias("more"))), F.col("doc_id") % 5
    reply = (
        F.when(n == 0, value).when(n == 1, F.concat(F.lit('<think>{"n": 0}</think> Sure:\n```json\n'), value, F.lit("\n```\ndone")))
        .when(n == 2, F.concat(F.lit("It is [so]: "), value, F.lit(" as asked."))).when(n == 3, F.concat(F.lit("```\nnone\n``` and ```json\n"), value, F.lit("```"))).otherwise(F.lit("no value here"))
    )
    parsed = table(spark, sf_dir, "documents").select("doc_id", models.parsed_reply(reply).alias("p"))
    return parsed.select("doc_id", F.get_json_object("p", "$.lang").alias("lang"), F.get_json_object("p", "$.n").cast("long").alias("n"))
