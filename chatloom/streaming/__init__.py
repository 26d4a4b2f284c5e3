"""Structured Streaming forms of the ingest path."""
