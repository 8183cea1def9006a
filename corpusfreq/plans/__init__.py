"""Plans of the corpus-frequency engine."""
