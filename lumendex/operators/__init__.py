"""Queries, matching and the inverted index."""
