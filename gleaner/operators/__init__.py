"""Operators on DataFrames: ranking, chunking, reranking, curation, evaluation, graphs and task types."""
