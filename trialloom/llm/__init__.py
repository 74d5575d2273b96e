"""Operators of a training-data pipeline: screening, deduplication, formatting and encoding of documents."""
