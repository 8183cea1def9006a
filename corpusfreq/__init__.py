"""corpusfreq: a Spark-native engine for subtitle cleaning, word-frequency norms and their evaluation."""
