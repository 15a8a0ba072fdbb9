"""Column expressions: text statistics, quality scores, similarity, scores of rankings."""
