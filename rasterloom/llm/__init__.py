"""Operators for training-data corpora: filters, deduplication, language models, tokenization."""
