"""Operators for building training data: private data, archives, duplicates, extraction, scoring and packing."""
