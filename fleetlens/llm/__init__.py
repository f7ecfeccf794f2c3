"""Operators for training data: private data, duplicates, tokens, packing and quality."""
