"""Operators for a training-data corpus: deduplication, filters, tokenisation and scoring of documents."""
