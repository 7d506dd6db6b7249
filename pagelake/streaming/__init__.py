"""Structured Streaming forms of the ingest operators."""
