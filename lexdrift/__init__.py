"""Temporal word embeddings and semantic shift on Spark."""
