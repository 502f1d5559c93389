import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gleaner import models
from gleaner.memory.facade import Memory
from gleaner.memory.oplog import VERBOSE, ListSink, OpLog
from gleaner.memory.policy import DefaultPolicy, RetainAllPolicy
from gleaner.memory.records import value_ref
from gleaner.memory.stores import JsonFileStore, NullStore
from gleaner.memory.working import WorkingMemory
from gleaner.tools import ToolContext, ToolInputError, arguments, registry, render
from gleaner.tools import shipped as t
from gleaner.tools.contracts import CONTRACTS, prefixes_for_stage, stage_for_tool_name
from gleaner.tools.framework import BaseTool, lineage, validate_tool_args, with_properties

ROWS = [
    {"id": "a", "text": "Rules for agents on the web. " * 3, "title": "Agents", "date": "2024-01-01", "url": "http://a"},
    {"id": "b", "text": "Cats sleep all day and dogs do not. " * 3, "title": "Pets", "date": "2024-02-01", "url": "http://b"},
    {"id": "c", "text": "Web agents need rules and rules need agents. " * 3, "title": "More", "date": "2024-03-01", "url": "http://c"},
]


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "news.jsonl"
    p.write_text("\n".join(map(json.dumps, ROWS)))
    return str(p)


def test_pipeline_from_file_to_judged_answer(spark, path, fake_llm):
    context = ToolContext(spark=spark)
    corpus = t.IngestCorpusTool().run({"path": path}, context=context)
    assert corpus["count"] == 3 and corpus["provenance"]["settings"]["path"] == "news.jsonl"
    chunks = t.ChunkBySizeTool().run({"input": corpus, "size": 8, "overlap": 2, "context": "title"}, context=context)
    llm = fake_llm({"queries": ["web agents", "Web Agents", {"query": "rules"}], "time_range": {"from": "2024-01-01", "to": None}})
    queries = t.RewriteQueryForRetrievalTool().run({"question": "What rules do web agents need?"}, context=context)
    assert queries["query_texts"] == ["web agents", "rules"] and queries["time_range"] == {"from": None, "to": None}
    found = t.RetrievePassagesTool().run({"query": "rules for agents", "input": chunks, "queries_input": queries, "size": 6}, context=context)
    assert found["returned"] == 6 and all(p["source_id"] in ("a", "c") for p in found["passages"][:4])
    kept = t.RerankPassagesTool().run({"input": found, "keep": 3, "max_per_source": 2}, context=context)
    assert [p["rank"] for p in kept["passages"]] == [1, 2, 3]
    llm.replies.append("<think>hm</think>Agents need rules [S1]. Unknown [S9].")
    answer = t.SynthesizeAnswerTool().run({"question": "What do agents need?", "input": kept, "facts": [{"subject": "x", "relation": "r", "object": "y"}]}, context=context)
    assert answer["cited"] == ["S1"] and answer["unknown_citations"] == ["S9"] and answer["uncited_facts"] == ["G1"] and answer["coverage"] == 1.0
    assert "](http://" in answer["answer_markdown"] and "[G1]" in llm.asked[-1]["messages"][1]["content"]
    llm.replies.append({"scores": {"faithfulness": 4.6, "relevance": {"score": "x"}}, "unsupported_claims": ["c"]})
    judged = t.ScoreRagAnswerTool().run({"answer": answer}, context=context)
    assert judged["scores"]["faithfulness"] == 5 and "relevance: no_judgement" in judged["review_flags"]
    assert [r["tool"] for r in lineage([corpus, chunks, found])] == ["ingest_corpus", "chunk_by_size", "retrieve_passages"]
    assert found["provenance"]["derived_from"] == [chunks["provenance"]["run_id"], queries["provenance"]["run_id"]]


def test_agent_mode_binds_the_newest_and_explicit_handles(spark, path):
    sink = ListSink()
    memory = Memory(session_id="s", oplog=OpLog(sink, level=VERBOSE))
    context = ToolContext(spark=spark, recordsets=memory, memory=WorkingMemory({"x": {}}))
    memory.begin_step()
    out = json.loads(t.IngestCorpusTool().execute({"path": path}, context=context))
    assert out["handle"] == "corpus_1" and memory.unconsumed_input_in_step()
    found = t.RetrievePassagesTool().run({"query": "cats"}, context=context)
    assert found["handle"] == "passages_1" and found["input_handle"] == "corpus_1" and memory.chained_in_step()
    assert [r["id"] for r in memory.records(memory.get("passages_1"))] == ["b"]
    kept = t.RerankPassagesTool().run({}, context=context)
    assert kept["query"] == "cats" and kept["input_handle"] == "passages_1"
    assert memory.dependents("corpus_1") == ["passages_1"] and memory.purge("corpus_1") == ["corpus_1", "passages_1"]
    with pytest.raises(ToolInputError) as e:
        t.RetrievePassagesTool().run({"query": "x", "input": "corpus_9"}, context=context)
    assert json.loads(str(e.value))["error"]["code"] == "unknown_recordset_handle"
    shown = t.ShowMemoryTool().run({}, context=context)
    assert [r["handle"] for r in shown["recordsets"]] == ["passages_2"] and shown["pointers"] == ["x"]
    memory.end_turn()
    assert {"write", "bind", "read", "purge", "bind_failed", "turn_summary"} <= set(sink.ops())


@pytest.mark.parametrize("args,code", [({"query": "x"}, "missing_required_arguments"), ({"query": "x", "corpus": "no"}, "unknown_corpus"), ({"query": "x", "corpus": "no", "strategy": "odd"}, "invalid_argument_value"), ({"query": "x", "recency_half_life_days": True}, "invalid_argument_value"), ({"query": "x", "date_from": "soon"}, "invalid_argument_value")])
def test_retrieval_errors(spark, args, code):
    with pytest.raises(ToolInputError) as e:
        t.RetrievePassagesTool().run(args, context=ToolContext(spark=spark))
    assert e.value.code == code


def test_strategies_filters_and_batch(spark, path):
    context = ToolContext(spark=spark)
    t.IngestCorpusTool().run({"path": path}, context=context)
    tool = t.RetrievePassagesTool()
    run = lambda **a: [p["id"] for p in tool.run({"query": "web agents rules", "corpus": "news"} | a, context=context)["passages"]]
    assert run()[0] == "c" and set(run(strategy="dense")) >= {"a", "c"} and set(run(strategy="hybrid")[:2]) == {"a", "c"}
    assert run(date_to="2024-01-31") == ["a"] and run(filters={"title": "More"}) == ["c"] and run(filters={"none": 1}) == []
    assert run(recency_half_life_days=1)[0] == "c"
    asked = spark.createDataFrame([(5, "cats"), (6, "rules")], "qid int, question string")
    from gleaner.sources.corpus import get_corpus

    got = tool.batch(asked, get_corpus("news"), {"size": 1}).collect()
    assert {r.qid: r.id for r in got} == {5: "b", 6: "c"}


def test_a_variant_overrides_one_hook(spark, path):
    class OnlyPets(t.RetrievePassagesTool):
        tool_name = "retrieve_pets"

        def keep(self, corpus, settings):
            return corpus.df["title"] == "Pets"

    context = ToolContext(spark=spark)
    t.IngestCorpusTool().run({"path": path}, context=context)
    out = OnlyPets().run({"query": "dogs agents", "corpus": "news"}, context=context)
    assert [p["id"] for p in out["passages"]] == ["b"] and out["provenance"]["tool"] == "retrieve_pets"


def test_test_questions_and_metrics(spark, path, fake_llm):
    context = ToolContext(spark=spark)
    t.IngestCorpusTool().run({"path": path}, context=context)
    fake_llm({"questions": [{"question": "Who sleeps?", "answer": "Cats", "type": "factual"}]}, "no json", {"questions": [{"question": "In this article?", "answer": "x"}]})
    made = t.ExtractTestQuestionsTool().run({"corpus": "news", "min_chars": 10, "size": 3}, context=context)
    assert len(made["questions"]) == 1 and made["skipped_records"] == 1 and made["type_counts"]["factual"] == 1
    items = [{"relevant": ["b"], "retrieved": ["a", "b"]}, {"relevant": [], "retrieved": [{"id": "c#1", "source_id": "c"}]}]
    told = t.CalculateRetrievalMetricsTool().run({"items": items, "k": [1, 2]}, context=context)
    assert told["rows"][0]["recall_at_2"] == 1.0 and told["rows"][1]["recall_at_1"] is None and told["summary"]["mrr"] == 0.25


def test_knowledge_graph_tool(spark, tmp_path):
    (tmp_path / "g.csv").write_text("subject,relation,object\na,r,b\n")
    (tmp_path / "s.json").write_text('{"x": 1}')
    out = t.IngestKnowledgeGraphTool().run({"path": str(tmp_path / "g.csv"), "schema_path": str(tmp_path / "s.json")}, context=ToolContext(spark=spark))
    assert out["graph"] == "g" and out["facts"] == 1 and out["has_schema"]


def test_registry_and_contracts():
    assert len(CONTRACTS) == 26 and stage_for_tool_name("retrieve_x") == "gather" and stage_for_tool_name("show_memory") is None
    assert prefixes_for_stage("preprocess") == ["chunk_", "clean_", "deduplicate_", "normalize_", "parse_"]
    names = registry.register_reference_tools(registry="test")
    assert len(names) == 11 and registry.resolve_tools(["chunk_by_size"], "test")[0].schema.name == "chunk_by_size"
    assert "chunk_by_size" in registry.tools_by_stage("test")["preprocess"] and registry.load_plugins("no.such.group") == []
    with pytest.raises(registry.ToolRegistrationError):
        registry.register_tool(t.ChunkBySizeTool(), registry="test")
    with pytest.raises(registry.ToolRegistrationError, match="task type"):
        registry.register_tool(t.ShowMemoryTool(), registry="other")
    with pytest.raises(KeyError, match="registered"):
        registry.resolve_tools(["nope"], "test")
    registry.clear_registry("test")


@pytest.mark.parametrize("args,code", [([], "invalid_arguments"), ({}, "missing_required_arguments"), ({"query": " "}, "invalid_argument_value"), ({"query": "x", "size": True}, "invalid_argument_type"), ({"query": "x", "queries": []}, "invalid_argument_value"), ({"query": "x", "queries": [""]}, "invalid_argument_value"), ({"query": 3}, "invalid_argument_value")])
def test_argument_validation(args, code):
    with pytest.raises(ToolInputError) as e:
        validate_tool_args(args, t.RetrievePassagesTool().schema)
    assert e.value.code == code
    validate_tool_args({"query": "x", "size": None, "other": 1}, t.RetrievePassagesTool().schema)


def test_render_and_schema_extension():
    assert json.loads(render.build_markdown_result("x"))["render"] == {"render_type": "markdown", "content": "x"}
    assert render.register_render_type("timeline") in render.structured_render_types()
    with pytest.raises(ValueError):
        render.build_render_payload("never")
    with pytest.raises(ValueError):
        render.build_tool_result(render_type="json", render={"render_type": "table"})
    own = json.dumps({"render": {"render_type": "table", "rows": []}})
    assert render.resolve_forced_tool_render(tool_name="x", result=own, is_error=False)["render_type"] == "table"
    shown = render.resolve_forced_tool_render(tool_name="x", result='{"error": {"code": "c", "message": "bad", "tool": "x"}}', is_error=True)["content"]
    assert shown.startswith("`x` failed at ") and "> c: bad" in shown and '"tool": "x"' in shown
    plain = render.resolve_forced_tool_render(tool_name="x", result="just text", is_error=False)
    assert plain["render_type"] == "markdown" and plain["content"].endswith("    just text\n")
    told = render.format_tool_help_markdown(name="a", description="d", input_schema={"properties": {"q": {"type": "string"}, "n": {}}, "required": ["q"]})
    assert "| q | string | required |" in told and "| n | any |  |" in told and 'Call: `/a {"q": "<string>"}`' in told
    assert "| `chunk_by_size` |" in render.format_tools_list_markdown([t.ChunkBySizeTool()])
    assert "note" not in render.render_types() and render.register_render_type("note", structured=False) not in render.structured_render_types()
    wider = with_properties(BaseTool.input_schema, {"n": {"type": "integer"}})
    assert wider["properties"] and not BaseTool.input_schema["properties"]


def test_memory_policies_and_stores(tmp_path):
    m = Memory(JsonFileStore(tmp_path), DefaultPolicy(page_size=2, max_per_object_type=1), session_id="s/1")
    keep = lambda rows, **k: m.remember(object_type="x", stage="analyze", produced_by="p", ref=value_ref(rows), args={"q": "é"}, **k)
    assert keep([]).handle == "x_1" and m.list() == [] and keep([1]).handle == "x_2" and keep([2], derived_from=["x_2"]).handle == "x_3"
    again = Memory(JsonFileStore(tmp_path), session_id="s/1")
    assert [r.handle for r in again.list()] == ["x_3", "x_2"] and again.store.allocate_handle(owner="session:s/1", object_type="x") == "x_4"
    assert m.compact() == ["x_2"] and m.get("x_2").tombstoned and "records" not in m.get("x_2").ref
    with pytest.raises(ToolInputError) as e:
        m.records(m.get("x_2"))
    assert e.value.code == "recordset_tombstoned" and m.records(m.get("x_3")) == [2]
    keep([3]), keep([4])
    page = m.digest(page=9)
    assert page.page == page.total_pages == 2 and page.total == 3 and "page 2/2" in page.text
    assert Memory().digest().is_empty and Memory(policy=RetainAllPolicy()).remember(object_type="y", stage="gather", produced_by="p", ref=value_ref([])).handle == "y_1"
    none = Memory(NullStore())
    none.remember(object_type="y", stage="gather", produced_by="p", ref=value_ref([1]))
    assert none.list() == []
    with pytest.raises(ToolInputError) as e:
        none.bind(object_type="y", tool_name="t")
    assert e.value.code == "missing_required_input"


def test_arguments_are_declared_once():
    class Sized(BaseTool):
        tool_name = "chunk_sized"
        arguments = {"size": arguments.count(5, most=9), "mode": arguments.Arg(default="a", choices=lambda tool: tool.modes), "day": arguments.Arg("date"), "rows": arguments.data("array")}
        modes = ("a", "b")

    class Wider(Sized):
        modes = ("a", "b", "c")

    assert Sized.input_schema["properties"]["size"] == {"type": "integer", "minimum": 1, "maximum": 9} and Wider().schema.input_schema == Sized.input_schema
    assert Wider().settings({"mode": "c", "rows": [1]}) == {"size": 5, "mode": "c", "day": None}
    for bad in ({"size": 0}, {"size": 10}, {"size": True}, {"size": "3"}, {"mode": "c"}, {"day": "soon"}):
        with pytest.raises(ToolInputError) as e:
            Sized().settings(bad)
        assert e.value.code == "invalid_argument_value" and e.value.tool_name == "chunk_sized" and e.value.details["argument"] in bad


class Refused(Exception):
    def __init__(self, message):
        super().__init__(message)
        self.status_code, self.message, self.body = 400, message, None


def test_endpoint_quirks_are_learned(fake_llm):
    llm = fake_llm(Refused("temperature is not supported"), Refused("response_format json_schema unknown"), Refused("json_object?"), "Sure: ```json\n{\"a\": 1}\n```", {"a": 2})
    schema = {"type": "object"}
    assert models.call_llm_json("s", "u", response_schema=schema) == {"a": 1}
    assert models.call_llm_json("s", "u", response_schema=schema) == {"a": 2}
    assert "temperature" not in llm.asked[-1] and "response_format" not in llm.asked[-1] and "JSON Schema" in llm.asked[-1]["messages"][0]["content"]


def test_replies_and_streams():
    assert models.parse_json_reply("<think>{}</think>so [1, 2] it is") == [1, 2]
    with pytest.raises(ValueError):
        models.parse_json_reply("none")
    for size in (1, 2, 7, 50):
        text = "  <think>a<b</think>\n  Hi <there"
        assert "".join(models.without_reasoning(text[i : i + size] for i in range(0, len(text), size))) == "Hi <there"
    assert "".join(models.without_reasoning(["<thi", "s is"])) == "<this is"
    with pytest.raises(RuntimeError, match="no language model"):
        models.model_for("fast")
    with pytest.raises(ValueError):
        models.ModelSpec(json_mode="odd")
    models.configure_llm(model="m", models={"fast": "f"})
    assert models.model_for("fast") == "f" and models.model_for("strong") == "m"


def test_embedder_runs_on_workers(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a a")], "_pos long, text string")
    got = {r._pos: list(r.embedding) for r in models.embed(df, lambda ts: [[float(t.count("a"))] for t in ts]).collect()}
    assert got == {0: [1.0], 1: [2.0]}
    asked = spark.createDataFrame([(1, "p")], "qid int, prompt string")
    assert models.map_llm(asked, lambda p: p + "!").first().reply == "p!"
    assert SimpleNamespace(x=1).x == 1


def test_parsed_reply_is_the_python_parser_on_every_kind(spark):
    """Clean replies are parsed by the engine, prose in Arrow; both agree with the parser of one reply."""
    texts = ['{"a": [1, 2.5, "x"]}', "[1]", "7", '"s"', "```json\n{\"b\": null}\n```", "<think>{\"no\": 1}</think>\n{\"c\": true}", 'Well, {"d": {"e": "}"}} is it', "```\nnothing\n```\n```json\n[2]\n```", "none", "", None, "{broken", '{"k": 1, "k": 2}', "[NaN]", "text [3] and {\"z\": 1}", "```{\"f\": 1}", "nul\x00 {\"g\": 1}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.p for r in df.select("i", models.parsed_reply(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        try:
            want = models.parse_json_reply(t)
        except ValueError:
            assert got[i] is None, t
        else:
            assert repr(json.loads(got[i])) == repr(want), t
