"""Streaming of the corpus-frequency engine."""
