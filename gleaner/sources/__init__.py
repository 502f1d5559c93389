"""Readers, corpora, embeddings on disk and their registries."""
