"""Operators for large training corpora: mixing, search, deduplication, extraction, privacy, packing."""
