"""Question-and-answer corpora, code benchmarks and training text on Spark."""
