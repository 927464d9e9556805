"""Operators for training-data pipelines: sharding, near-duplicates, mixing, scoring and tokens."""
