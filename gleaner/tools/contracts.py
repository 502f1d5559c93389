"""The task types: which stage each prefix belongs to, and what a tool of that type turns into what."""

from __future__ import annotations

from dataclasses import dataclass

#: The stages in their order.
STAGE_ORDER = ["prepare", "gather", "preprocess", "extract", "analyze", "enrich"]
STAGE_DESCRIPTIONS = {
    "prepare": "Turn a request into a plan that can be reviewed before any evidence is touched.",
    "gather": "Get the source records: ingest, find and order them, without changing what they say.",
    "preprocess": "Make records fit for analysis: parse, clean, normalize, deduplicate, chunk.",
    "extract": "Take out of raw data what a question needs, in a given form.",
    "analyze": "Derive results by explicit methods: counts, measures, classes, comparisons, scores.",
    "enrich": "Add context and judgement: answers, explanations, assessments, checks, advice.",
}
RESEARCH_PIPELINE_STAGES = [s for s in STAGE_ORDER if s != "prepare"]


@dataclass(frozen=True)
class Contract:
    prefix: str
    stage: str
    takes: str
    gives: str
    does: str


#: Fixed values in prefix and stage; the rest says in our words what the type is for.
CONTRACTS = [
    Contract("plan_", "prepare", "a request", "a brief with questions, sources and steps", "Plan the work."),
    Contract("ingest_", "gather", "a file, table or service", "a registered source of records", "Read records in."),
    Contract("rewrite_", "gather", "a question", "search queries", "Phrase a question as queries."),
    Contract("retrieve_", "gather", "queries and a source", "ranked records", "Find the records that fit."),
    Contract("rerank_", "gather", "a question and candidates", "reordered candidates", "Order candidates by a closer look."),
    Contract("parse_", "preprocess", "raw content", "structured records", "Take content apart."),
    Contract("clean_", "preprocess", "texts", "texts without what is not theirs", "Remove noise, keep meaning."),
    Contract("normalize_", "preprocess", "fields in many forms", "fields in one form", "Bring values to one form."),
    Contract("deduplicate_", "preprocess", "records", "records without repeats, and the groups", "Find repeated records."),
    Contract("chunk_", "preprocess", "texts", "passages with their places", "Cut texts into passages."),
    Contract("extract_", "extract", "texts", "facts or questions with sources", "Take out what is stated."),
    Contract("detect_", "extract", "texts and patterns", "occurrences with evidence", "Find occurrences."),
    Contract("resolve_", "extract", "names", "names with one form each", "Tell which names are one thing."),
    Contract("aggregate_", "analyze", "records", "counts and sums by group", "Summarise by group."),
    Contract("calculate_", "analyze", "records", "measures", "Compute measures."),
    Contract("classify_", "analyze", "records and classes", "records with classes", "Assign classes."),
    Contract("compare_", "analyze", "two or more results", "differences", "Put results side by side."),
    Contract("score_", "analyze", "items and criteria", "scores with reasons", "Judge by criteria."),
    Contract("synthesize_", "enrich", "evidence", "an answer with citations", "Write from evidence."),
    Contract("enrich_", "enrich", "records and context", "records with context", "Add what is known elsewhere."),
    Contract("benchmark_", "enrich", "a value and its peers", "its place among them", "Place a value among peers."),
    Contract("interpret_", "enrich", "results", "what they mean", "Say what results mean."),
    Contract("explain_", "enrich", "a result", "why it came about", "Say why."),
    Contract("assess_", "enrich", "evidence on a question", "a judgement with reasons", "Weigh evidence."),
    Contract("recommend_", "enrich", "findings and aims", "options with reasons", "Advise."),
    Contract("validate_", "enrich", "results and rules", "passes and failures", "Check results against rules."),
]


def prefix_to_stage() -> dict[str, str]:
    return {c.prefix: c.stage for c in CONTRACTS}


def prefixes_for_stage(stage: str) -> list[str]:
    return sorted(c.prefix for c in CONTRACTS if c.stage == stage)


def stage_for_tool_name(name: str) -> str | None:
    """The stage of the longest prefix that the name starts with."""
    fits = [c for c in CONTRACTS if name.startswith(c.prefix)]
    return max(fits, key=lambda c: len(c.prefix)).stage if fits else None
