"""Functions of the corpus-frequency engine."""
