"""Operators on text corpora: mixing, filtering, deduplication, language, tokens."""
