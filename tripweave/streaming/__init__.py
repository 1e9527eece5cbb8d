"""Structured Streaming variants of the monthly ingest."""
