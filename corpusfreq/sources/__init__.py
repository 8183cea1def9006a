"""Sources of the corpus-frequency engine."""
