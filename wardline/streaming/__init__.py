"""Incremental variants over Structured Streaming."""
