"""Operators on training data: mixing, deduplication, search, scans, tokens, extraction and language."""
