"""Structured Streaming versions of the record operators."""
