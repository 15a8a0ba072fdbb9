"""Spark-first text-corpus analytics: quality, retrieval, deduplication, validation and streaming."""
