"""Column expressions: cleaning, classes, scores, configuration values."""
