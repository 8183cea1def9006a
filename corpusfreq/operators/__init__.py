"""Operators of the corpus-frequency engine."""
