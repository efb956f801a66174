"""Operators of a training-data pipeline: deduplication, filters, extraction, packing and formatting."""
