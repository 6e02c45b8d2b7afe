"""Operators of a training-data pipeline: language, quality, duplicates, leaks, private data, token output."""
