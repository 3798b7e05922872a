"""Operators for large training-data pipelines: archives, extraction, languages, near copies, mixing, shards."""
