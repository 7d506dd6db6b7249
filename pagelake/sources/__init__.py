"""Readers, writers and ingest-side operators."""
