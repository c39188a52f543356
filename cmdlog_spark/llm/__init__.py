"""Operators of a training-data pipeline: filter, deduplicate, mix and pack."""
