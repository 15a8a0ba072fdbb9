"""Stateful operators and their Structured Streaming forms."""
