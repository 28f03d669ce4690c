"""Structured Streaming forms of the query language."""
