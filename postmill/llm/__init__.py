"""Operators for training-data pipelines: search, language, formatting, tokens, duplicates, personal data, mixing, quality, shards."""
