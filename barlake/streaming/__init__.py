"""Structured Streaming form of the incremental refresh."""
