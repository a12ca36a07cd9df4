"""Structured Streaming entry points (incremental ingest of new submission files)."""
