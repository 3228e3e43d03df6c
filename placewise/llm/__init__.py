"""Operators for training-data pipelines: near-duplicates, tokens, classifiers, search, sharding, mixing, chat, URLs."""
