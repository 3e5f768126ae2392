"""Column expressions: text clean-up, similarity measures, error rules."""
