"""Structured Streaming ingest and question answering."""
