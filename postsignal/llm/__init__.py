"""Operators that prepare training data for language models: deduplication, sharding, mixing, tokens,
quality, vector search and URL filters. Nothing else in the library imports this subpackage."""
