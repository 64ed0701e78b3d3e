"""Operators for preparing training data: search, deduplication, packing, tokens, shards, privacy, language."""
