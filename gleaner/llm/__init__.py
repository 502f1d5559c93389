"""Training-data operators: WARC revisits, deduplication, decontamination, quality, PII, chat and packing.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to a DataFrame
with its own parameters; ``gleaner.llm.queries`` holds the thin registered queries.
"""
