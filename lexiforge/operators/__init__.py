"""Operators on DataFrames: classification, retrieval, deduplication, roll-ups, validation, evaluation, discovery."""
