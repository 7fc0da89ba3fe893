"""Operators of a training-data pipeline: tokenising, extraction, search, deduplication, filters."""
