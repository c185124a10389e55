"""Readers, writers and the chunk / index tables."""
