"""Structured Streaming forms of the event ledgers."""
