"""Operators of a training-data pipeline: extraction, filtering, deduplication, sanitisation and packing."""
