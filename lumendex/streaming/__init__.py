"""Ingest from Structured Streaming."""
