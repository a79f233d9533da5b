"""Operators for preparing training data: deduplication, filtering, scoring, search, mixing, sharding."""
